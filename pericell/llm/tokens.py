"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into chunks, each a run of white space and the run of other
characters after it. The byte-level pre-tokenizer never joins a character with
white space that follows it, and its only look-ahead is inside white space, so
the tokens of a text are those of its chunks. Chunks go to the library's batch
encoder, in batches of about ``batch_bytes``; a worker remembers the lengths of
the distinct chunks that it has had encoded, so each goes there once while it is
remembered. The memory is bounded and only saves time. Long texts are cut into
spans of about ``span_chars`` at such boundaries, and where a letter meets a digit,
which are two pre-tokens too; a span without either, such as one endless word, goes
whole. A vocabulary that is not byte-level has its texts encoded whole.

Null and empty texts count 0 tokens. Repeated rows are counted each. An empty table
gives none, and there are no ties. Columns other than the named ones are not read, so
clashing names cannot arise.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space of the Unicode standard, as the pre-tokenizer's \s has it (fixed values).
SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BOUNDARY = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
# For packing, which needs the ids themselves. Texts of ASCII and Latin letters: for those the library's split into pre-tokens is written out here, and the
# distinct pre-tokens go to its model. Chunks of other texts go to the library as they are.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SIMPLE = re.compile(rf"[\x00-\x7f{LATIN}]+").fullmatch
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \t-\r0-9{LATIN}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
PROBE = " a probe's text, I'll say:\n\n  \tna\xefve 12ab (x) \x00\x7f\x1c!!  \u0159e\n"
REMEMBER = 400_000


def vocabulary(name: str) -> str:
    """A path as it is, or the place of a public vocabulary file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def cut(text: str, most: int) -> Iterator[str]:
    """Spans of about ``most`` characters that end at safe boundaries; a span without one stays whole."""
    lo = 0
    while len(text) - lo > most:
        found = BOUNDARY.search(text, lo + most)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others in order from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def batches(chunks: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive chunks of about ``most`` bytes together, longest first, so that those of a batch are about as long."""
    own, size = [], 0
    for chunk in sorted(chunks, key=len, reverse=True):
        own.append(chunk)
        size += len(chunk.encode("utf-8", "surrogatepass"))
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


class Chunks:
    """Remembers what ``value`` makes of the ids of each distinct chunk.

    ``direct``: pre-tokens of Latin texts go to the library's model one by one instead, where that gives the same ids.
    """

    def __init__(self, name: str, value: Callable, direct: bool = False, batch_bytes: int = 1 << 20):
        self.library, self.value, self.known, self.batch_bytes = tokenizer(name), value, {}, batch_bytes
        split = json.loads(self.library.to_str())
        split = (split["normalizer"], split["pre_tokenizer"])
        self.chunked = split[0] is None and split[1] and (split[1]["type"], split[1].get("add_prefix_space"), split[1].get("use_regex", True)) == ("ByteLevel", False, True)
        self.model, self.letters = self.library.model, byte_letters()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.direct = direct and self.chunked and [i for p in PRE_TOKEN.findall(PROBE) for i in self._ids(p)] == self.library.encode(PROBE, add_special_tokens=False).ids

    def _ids(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]

    def cut(self, text: str, most: int) -> Iterator[str]:
        return cut(text, most) if self.chunked else iter([text])

    def of(self, texts: list[str]) -> list[list]:
        """For each text what its parts stand for, in order. New chunks of all texts go to the library together."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        parts, values, pre_tokens, chunks = [], [], set(), set()
        for text in texts:
            simple = self.direct and SIMPLE(text) and not self.added(text)
            own = (PRE_TOKEN if simple else CHUNK).findall(text) if self.chunked else [text]
            found = list(map(self.known.get, own))
            if None in found:
                (pre_tokens if simple else chunks).update(c for c, v in zip(own, found, strict=True) if v is None)
            parts.append(own)
            values.append(found)
        for p in pre_tokens:
            self.known[p] = self.value(self._ids(p))
        for batch in batches(list(chunks), self.batch_bytes):
            for c, e in zip(batch, self.library.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.known[c] = self.value(e.ids)
        for own, found in zip(parts, values, strict=True):
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self.known[own[at]]
        return values


@lru_cache(4)
def counter(name: str, batch_bytes: int) -> Chunks:
    return Chunks(name, len, batch_bytes=batch_bytes)


def lengths(texts: list[str | None], name: str, batch_bytes: int, span_chars: int) -> list[int]:
    """Tokens of each text. Spans of all texts are taken about ``batch_bytes`` at a time."""
    out, batch, owners, size = [0] * len(texts), [], [], 0
    chunks = counter(name, batch_bytes)

    def flush() -> None:
        for i, values in zip(owners, chunks.of(batch), strict=True):
            out[i] += sum(values)

    for i, text in enumerate(texts):
        for span in chunks.cut(text or "", span_chars):
            batch.append(span)
            owners.append(i)
            size += len(span.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                flush()
                batch, owners, size = [], [], 0
    flush()
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, batch_bytes: int = 1 << 20, span_chars: int = 1 << 16) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text, whole. No shuffle."""
    from .store import tidy
    from .words import slices

    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, n_tokens bigint, n_bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                n = lengths(batch.column("text").to_pylist(), vocabulary, batch_bytes, span_chars)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), batch.column("size")], [id_col, "n_tokens", "n_bytes"])
        tidy()

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    return given.mapInArrow(run, schema).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
