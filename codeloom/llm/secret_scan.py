"""Secret scan by token efficiency.

A random string costs many tokens for its length under a vocabulary learned
from ordinary text. A candidate is a run of base64-like characters of at least
``min_chars``; it is reported when its characters a token stay under
``max_ratio``. Known digests, UUIDs, numbers and integrity hashes are left out,
unless the string is assigned to a name such as password or token, where a
digest-like value is a credential. A bare string without a digit counts only
with a provider's prefix.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MIN_CHARS, MAX_RATIO = 16, 2.6

NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|bearer)[\w-]{0,24}[\"']?\s*(?::=|=>|[:=]|\s)\s*[\"']?$")
PREFIX = re.compile(r"(?:AKIA|ASIA|ABIA|ACCA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk_live_|sk-|rk_live_|AIza|ya29|npm_|pypi-|SG|eyJ)")
DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z")
NUMBER = re.compile(r"[\d+/_-]+=*\Z")
INTEGRITY = re.compile(r"(?i)(?:(?:sha(?:1|224|256|384|512)|md5|blake2[bs])[-:]|;base64,)\Z")
FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("n_chars", pa.int32()), ("n_tokens", pa.int32()), ("ratio", pa.float64()), ("digest", pa.string())]


@cache
def encoding(content: bytes) -> tiktoken.Encoding:
    """A vocabulary from the content of its file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@cache
def loaded(path: str) -> bytes:
    return Path(path).read_bytes()


@cache
def candidates(min_chars: int) -> re.Pattern:
    return re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % min_chars)


def find(text: str | None, vocabulary: str | bytes = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> list[tuple]:
    """(start, end, kind, characters, tokens, ratio, sha256 prefix) of each secret in text, in order; [] for null or empty. vocabulary: a path, or a file's content."""
    out = []
    content = loaded(vocabulary) if isinstance(vocabulary, str) else vocabulary
    for m in candidates(min_chars).finditer(text or ""):
        s, at = m.group(), m.start()
        known = PREFIX.match(s)
        named = NAMED.search(text, max(0, at - 64), at)
        if not (named or known or any(c.isdigit() for c in s)):
            continue
        if not named and (DIGEST.match(s) or UUID.match(s) or NUMBER.match(s) or INTEGRITY.search(text, max(0, at - 10), at)):
            continue
        tokens = len(encoding(content).encode_ordinary(s))
        if len(s) / tokens < max_ratio:
            out.append((at, m.end(), "named" if named else "prefix" if known else "bare", len(s), tokens, len(s) / tokens, hashlib.sha256(s.encode()).hexdigest()[:12]))
    return out


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """A row for each secret: doc_id, start and end in characters, kind, counts, ratio, digest (never the secret).

    Null and empty texts give none; a null doc_id stays null; repeated rows are
    reported once each; other columns are not read.
    """
    # The file is read here and sent, for workers may not have it.
    sent = docs.sparkSession.sparkContext.broadcast(loaded(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                hits = find(text.as_py(), sent.value, min_chars, max_ratio)
                at += [i] * len(hits)
                found += hits
            if found:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["doc_id", *[n for n, _ in FIELDS]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start int, end int, kind string, n_chars int, n_tokens int, ratio double, digest string")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with each secret replaced by ``mask`` and n_chars (where there is one) counted anew; every row stays, other columns as they came."""
    sent = docs.sparkSession.sparkContext.broadcast(loaded(vocabulary))

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            for hit in reversed(find(text, sent.value, min_chars, max_ratio)):
                text = text[: hit[0]] + mask + text[hit[1] :]
            return text

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document; edge cases are those of ``scan_secrets``."""
    return scan_secrets(table(spark, sf_dir, "documents"))
