"""Secret scan: fixed patterns, and strings that a primed compressor cannot shorten.

Patterns (``assign``, ``access``, ``hex``) give the base spans. The method proper looks at every string of
``LEAST_LENGTH`` or more key characters that follows a sensitive word within ``CONTEXT`` characters and
asks how many bytes it adds when zstandard, primed with a dictionary of identifiers, compresses it behind
its surrounding text: novelty = (size(context + string) - size(context)) / length. Words, paths and
identifiers repeat what the dictionary or the surroundings have and cost little; random strings cost
nearly their length. Strings at or above ``least_novelty`` are reported as ``novel`` unless a base span
covers part of them.

Spans are in code points, end exclusive. Cases: null and empty texts have no spans; a very long text is
scanned whole; equal ids and repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import map_batches

KINDS = ("assign", "access", "hex", "novel")
LEAST_LENGTH = 20
CONTEXT = 64
LEAST_NOVELTY = 0.75

# Fixed values of the base contract.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE = 6

# Words the assign pattern cannot do without; a text with none of them is not searched for it.
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_SENSITIVE = re.compile(r"passw|secret|token|api.?key|credential|bearer|authorization|private.?key|client.?id|signature", re.I)
_SENSITIVE_WORDS = ("passw", "secret", "token", "api", "credential", "bearer", "authorization", "private", "client", "signature")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")

# Identifiers of ordinary code and prose around keys; parts of the dictionary that primes the compressor.
_IDENTIFIERS = """
access_token refresh_token client_secret client_id api_key apikey password passwd username authorization
bearer basic content-type application/json private_key public_key begin end certificate signature session
cookie header request response config settings environment variable default example placeholder changeme
your-token-here your_api_key_here insert-secret-here xxxxxxxxxxxxxxxxxxxx 00000000000000000000
123456789012345678901234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
database connection string localhost production staging development test_user get_secret_value
function return import export const public static final class self this null true false undefined
https://www.example.com/path/to/resource?query=value&page=1 the of and to in is that for with this from
"""


@lru_cache(maxsize=4)
def _compressor(extra: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(
        extra + _IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    # No checksum, size or dictionary id: only bytes that carry content count.
    parameters = zstandard.ZstdCompressionParameters.from_level(
        19, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=parameters)


def novelty(candidate: str, before: str, after: str, extra: bytes = b"") -> float:
    """Marginal compressed bytes of ``candidate`` per byte, its surroundings known."""
    packer = _compressor(extra)
    around = (before + after).encode()
    alone = len(packer.compress(around))
    return (len(packer.compress(around + candidate.encode())) - alone) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans: leftmost matches per kind, failing ones dropped."""
    spans = []
    folded = text.lower()
    if any(word in folded for word in _ASSIGN_WORDS):
        found = _ASSIGN.finditer(text)
        spans += [("assign", m.start(), m.end()) for m in found if len(m[2]) >= _LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def novel_spans(
    text: str, taken: list[tuple[str, int, int]], least_novelty: float = LEAST_NOVELTY, extra: bytes = b""
) -> list[tuple[str, int, int]]:
    """Incompressible strings behind a sensitive word, apart from the spans already taken."""
    folded = text.lower()
    if not any(word in folded for word in _SENSITIVE_WORDS):
        return []
    taken = sorted((s, e) for _, s, e in taken)
    spans, k, reach = [], 0, -1
    words = _SENSITIVE.finditer(text)
    word = next(words, None)
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while word is not None and word.end() <= start:
            reach = word.end() + CONTEXT
            word = next(words, None)
        if start > reach:
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        before, after = text[max(0, start - 4 * CONTEXT) : start], text[end : end + 4 * CONTEXT]
        if novelty(m[0], before, after, extra) >= least_novelty:
            spans.append(("novel", start, end))
    return spans


def listed(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then by kind as listed, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_novelty: float = LEAST_NOVELTY,
    identifiers: str = "",
) -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>, base_spans string, all_spans string)`` per row.

    ``identifiers`` are put in front of the built-in dictionary, for the names of a code base.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = identifiers.encode()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, base_text, all_text = [], [], []
        for text in batch.column("_text").to_pylist():
            base = base_spans(text) if text else []
            spans = base + (novel_spans(text, base, least_novelty, extra) if text else [])
            every.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            base_text.append(listed(base))
            all_text.append(listed(spans))
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.record_batch(
            {
                "_id": batch.column("_id"),
                "spans": pa.array(every, pa.list_(span)),
                "base_spans": pa.array(base_text, pa.string()),
                "all_spans": pa.array(all_text, pa.string()),
            }
        )

    schema = f"_id {kind}, spans array<struct<kind:string,start:long,end:long>>, base_spans string, all_spans string"
    found = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)
    return found.withColumnRenamed("_id", id_col)


def redact(text: str, spans: Iterator[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(
    docs: DataFrame, text_col: str = "text", least_novelty: float = LEAST_NOVELTY, identifiers: str = ""
) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; rows without any are unchanged."""
    extra = identifiers.encode()

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not text:
                return text
            base = base_spans(text)
            return redact(text, base + novel_spans(text, base, least_novelty, extra))

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))
