"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage.

Rules that hold for every operator, besides those in its own docstring:

* An empty table gives an empty result; a language model fitted on nothing knows no language.
* A null text is an empty text, unless the docstring says that such rows pass unchanged.
* Texts are processed whole, however long; what is cut into blocks is put together again.
* Rows that are repeated are each given a result.  Where rows are told apart by doc_id, those
  that repeat one are parts of one document; a null doc_id is a document of its own that
  neither loses anything nor makes others lose anything.
* Ties go to the smaller id, then to the smaller position.
* Extra columns are carried where a table of documents is returned, and left aside elsewhere.
  They never meet an operator's own names; a result column replaces one of the same name.
"""
