"""Secret scans: patterns, and the novelty of candidates to a primed zstandard compressor.

The base kinds are patterns.  For novelty, a candidate is a run of 12 or more token
characters that starts within ``NEAR`` characters after a sensitive word.  What
it adds to the compressed size of the code around it, with a dictionary of common
identifiers, is its marginal size; a string that costs at least ``LEAST_RATE`` bytes a
character, more than words, names and repeats of the text around it do, is reported.
Base spans are measured too and stay whatever they cost; a candidate that overlaps one
is not reported again.  Offsets are in code points, ends exclusive.

Null and empty texts have no spans.  Spans that start together are in the order of the
kinds; equal spans of several kinds all stay.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import small_batches

# The kinds in their order, their patterns and least lengths: fixed values.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Words that make what follows sensitive.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|auth|signature|client.?id|akia", re.IGNORECASE | re.ASCII)
LEAST_RUN = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}", re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_=-]+", re.ASCII)
NEAR, AROUND, LEAST_RATE, LEVEL = 48, 256, 0.55, 3

#: What code and settings are full of; it primes the compressor.
IDENTIFIERS = (
    "def class return import from public static void const let var function private protected final string int long double bool "
    "self this None null true false if else for while try except catch throw new async await lambda yield with as in is not and or "
    "username user_name userid user_id account account_id client_id client_secret access_key access_token refresh_token session_id "
    "password passwd secret token api_key apikey authorization bearer basic credential credentials private_key public_key signature "
    "https://www.example.com http://localhost:8080 /usr/local/bin /etc/config/settings.json application/json content-type user-agent "
    "config settings environment production development staging version release build test example sample default placeholder changeme "
    "getElementById addEventListener toString valueOf prototype constructor __init__ __main__ __name__ request response status_code "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 xxxxxxxxxxxxxxxx ================ "
    "2019-01-01T00:00:00Z 2024-12-31 v1.0.0 v2.0.1 sha256 md5 utf-8 base64 "
)


@functools.lru_cache(1)
def _compressor():
    import zstandard

    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes a UTF-8 byte of text[start:end], given the text around it and the identifiers."""
    size = _compressor().compress
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    own = text[start:end].encode("utf-8", "replace")
    before = around.encode("utf-8", "replace")
    return (len(size(before + own)) - len(size(before))) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int, float]], int]:
    """((start, kind, end, novelty) of all spans in order, how many are base spans)."""
    base = base_spans(text)
    out = [(s, k, e, novelty(text, s, e)) for s, k, e in base]
    # Candidates start within NEAR of a sensitive word; stretches of such places are scanned once.
    at = 0
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(at, word.start()), min(len(text), word.end() + NEAR + LEAST_RUN)):
            s = m.start()
            e = RUN.match(text, s).end()  # a run may go on beyond the stretch
            at = max(at, e)
            if any(s < b and a < e for a, _, b in base):
                continue
            rate = novelty(text, s, e)
            if rate >= LEAST_RATE:
                out.append((s, 3, e, rate))
    return sorted(out), len(base)


OUT = "doc_id long, spans array<struct<kind:string,start:int,end:int,novelty:double>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row; null and empty texts have no spans, repeated rows their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": n} for s, k, e, n in scan(t)[0]] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, SPANS)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def op8_secret_scan(spark, sf_dir):
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    joined = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined("filter(spans, s -> s.kind <> 'novel')"), 256).alias("base_sha256"), joined("spans").alias("spans"), of("novel")
    )
