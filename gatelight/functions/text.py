"""Text expressions: native Columns, evaluated in the JVM; sparse vectors alone are counted in Python, a batch at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark an answer as a refusal.
REFUSAL_PHRASES = (
    "情報は現在の資料には含まれていません",
    "資料には含まれていません",
    "情報なし",
    "確認できません",
    "資料に記載がありません",
    "見つかりませんでした",
)

# Fixed value: size of the hashed vocabulary.
VOCABULARY = 131072

# Whitespace as Unicode sees it plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
# Any character that ends a line.
_LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Fixed value: the characters read in pairs, U+3000 to U+FAFF.
_WIDE = r"([\x{3000}-\x{faff}])"
_WORD = r"([a-zA-Z0-9]+)"
_SENTENCE_END = r"(?U)(?<=[。．.!?！？])[\s\x1c-\x1f]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def json_value(text: Column) -> Column:
    """The text read as exactly one JSON value (variant), null when it is anything else.

    Read as the only element of an array, since the parser ignores what follows a value.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, 0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_SPACE}+", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(without_space(text), F.lit("")) == ""


def quoted_verbatim(quote: Column, body: Column) -> Column:
    """The quote occurs in the body when whitespace is ignored; an empty quote does not."""
    bare = without_space(F.coalesce(quote, F.lit("")))
    return (bare != "") & F.contains(without_space(F.coalesce(body, F.lit(""))), bare)


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences ending in one of the six stop marks, trimmed, no empties."""
    return _kept(F.split(text, _SENTENCE_END))


def sentence_lines(text: Column) -> Column:
    """As :func:`sentences`, and a line break ends a sentence too."""
    return _kept(F.flatten(F.transform(sentences(text), lambda s: F.split(s, _LINE_END))))


def basename(path: Column) -> Column:
    """File name behind the last ``/`` or ``\\``; null gives an empty text."""
    no_drive = F.regexp_replace(path, r"(?s)\A(?:.:|[/\\]{2}[^/\\]+[/\\][^/\\]+)", "")
    return F.coalesce(F.regexp_extract(no_drive, r"([^/\\]*)\z", 1), F.lit(""))


def is_refusal(answer: Column) -> Column:
    hit = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        hit = hit | F.contains(answer, F.lit(phrase))
    return hit


def keyword_share(answer: Column, keywords: Column) -> Column:
    """Share of the keywords found in the answer; 1 when none is expected."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(answer, k)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 1.0).otherwise(hits / F.size(keywords))


def tokens(text: Column) -> Column:
    """Pairs over the run of all wide characters, then lower-cased ASCII words."""
    pairs = let(
        F.regexp_extract_all(text, F.lit(_WIDE), 1),
        lambda c: F.when(
            F.size(c) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(c) - 1),
                lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), 1), F.lower)
    return F.concat(pairs, words)


def token_id(token: Column) -> Column:
    """First four bytes of the sha256, read as one number, into the vocabulary."""
    head = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint")
    return (head % VOCABULARY).cast("int")


# Tokens whose ids a worker remembers, and texts whose ids are held at once.
_REMEMBERED = 1 << 16
_TEXTS_PER_STEP = 1_024
#: Bytes of words, A-Z in lower case; all others are blanks.
_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in bytes(range(256)).lower())
_WIDE_CHARACTERS = re.compile("[\u3000-\ufaff]")


class TokenIds(dict):
    """Ids of tokens in UTF-8, as :func:`token_id` gives them; forgotten when there are too many."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[token] = found = int.from_bytes(hashlib.sha256(token).digest()[:4], "big") % VOCABULARY
        return found


def _row_ids(text: str, ids: TokenIds) -> list[int]:
    """Ids of all :func:`tokens` of a text."""
    # No character outside ASCII has a byte that a word may hold.
    found = list(map(ids.__getitem__, text.encode().translate(_WORD_BYTES).split()))
    if not text.isascii():
        wide = _WIDE_CHARACTERS.findall(text)
        found += [ids[(a + b).encode()] for a, b in zip(wide, wide[1:])]
    return found


def counted_ids(texts: pa.Array, ids: TokenIds) -> pa.Array:
    """Sparse vectors of texts: sorted pairs of row and id, equal runs counted."""
    rows = [[] if t is None else _row_ids(t, ids) for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
    pairs, times = np.unique(np.repeat(np.arange(len(rows)), lengths) * VOCABULARY + flat, return_counts=True)
    row = pairs // VOCABULARY
    held = pa.StructArray.from_arrays([pa.array((pairs % VOCABULARY).astype(np.int32)), pa.array(times / lengths[row])], ["i", "v"])
    stops = np.append(0, np.cumsum(np.bincount(row, minlength=len(rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), held, mask=texts.is_null() if texts.null_count else None)


def sparse_vector(text: Column) -> Column:
    """Term frequencies per hashed id, ids ascending: array<struct<i,v>>; null without a text.

    A batch's ids are sorted once and equal runs are counted, so no row leaves its task.
    """

    @F.arrow_udf("array<struct<i:int,v:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = TokenIds()
        for batch in batches:
            parts = [counted_ids(batch.slice(at, _TEXTS_PER_STEP), ids) for at in range(0, len(batch), _TEXTS_PER_STEP)]
            yield pa.concat_arrays(parts) if parts else counted_ids(batch, ids)

    return run(text)
