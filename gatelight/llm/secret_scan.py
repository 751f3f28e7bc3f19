"""Secrets in texts: fixed patterns, and tokens that look random to two character models.

Everything runs as DataFrame expressions. Three patterns give the base spans. Beyond them,
every long token is read by two first-order Markov models of characters, one of random
strings and one of ordinary identifiers; where the log-likelihood ratio is at least
``margin``, the token is a span of kind ``markov``.

``train`` counts character pairs of labelled samples, at most 2 x 129 x 128 rows after
grouping, and turns them into one table of log ratios in thousandths of a nat. Samples come
from ``labelled_samples``, for the larger part of about ``documents`` rows chosen by a hash
of the id. Random are the values the patterns find, and generated digests in both base64
alphabets. Ordinary is every other token that is not plainly random (more than a third of its
steps change between letters, digits and case), and compounds of words and numbers (hyphens,
paths, options, camel case, dates): three words of the text each, and from a fixed list, as
few texts hold such tokens themselves. Repeated characters and signs side by side never count
as random.

Places count code points, ends are exclusive. Null and empty texts have no spans. Texts are
read whole, repeated rows give equal rows, ids may be null or repeat; other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text

# Kinds in order, their patterns, and the least length of what they catch.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

# A step of a token that changes between letters and digits, or to upper case.
_CHANGE = r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"
# Words of identifiers, paths and titles, for compounds where texts have few.
_WORDS = (
    "the and for with from that this are was not you all have new more one some about long short title here there known well tested very good best first last next time year day world people news story page "
    "get set put add user users name names id by to of in on at is has label labels value values key keys index count total size length type types list map table row rows column file files path folder home usr var etc lib local share bin "
    "org com net apache spark sql functions function class method module package python java script source sources test tests main build target config configuration settings option options default data base database query queries schema "
    "server client service request response session cache log logs error errors message messages event events job task worker queue thread process system network host port address http https api version release update final draft "
    "profile image images video media content document documents report reports summary chapter section article post posts blog archive index home product products order orders item items customer account invoice number code state status "
    "left right top bottom start end begin open close read write load save create delete remove insert select find search sort merge split join group filter transform convert parse format string text word words line lines char byte "
    "north south east west prod dev stage staging zone region cluster node nodes pod volume disk memory core micro small large max min avg sum mean rate limit step batch stream window model train learning deep vector tree graph "
    "quick brown fox jumps over lazy dog school house water light green black white state government business company market money health music paper book books question answer example example project team review change development"
).split()
# Forms of compounds of three words.
_FORMS = (
    "{a}-{b}-{c}", "{a}_{b}_{c}", "{a}/{b}/{c}", "{a}{B}{C}", "{a}{B}", "{A}{B}{C}", "{A}{B}{digit}{C}", "{a}{B}{digit}{C}", "{A}{B}", "{a}{U}{B}", "{A}{U}{digit}{B}", "{a}{B}{C}{year}", "/{a}/{b}_{c}/", "--{a}-{b}={c}", "{a}={year}/{b}={day}", "/{year}/{month}/{day}/{a}-{b}",
    "{year}-{month}-{day}-{a}-{b}", "{a}_{b}_{year}_{c}", "{a}_{year}_{month}{day}", "{a}{digit}-{b}-v{day}-{c}", "{digit}{a}/{b}{day}", "{day}-{digit}-{year}-{month}-{year}", "{year}{month}{day}/{year}{month}{day}",
    "{a}+{b}+{year}+{c}", "=={A}=={b}==", "_{a}__{b}/{C}-{digit}",
)

_CHARS = 128
_MOST = 4.0  # nats that a single step may speak for randomness
_START = 128  # row of the table for the first character


def _spans(text: Column, pattern: str, matches: Column, keep: Column) -> Column:
    """(start, end) of the matches with ``keep`` true, in one walk over the gaps between matches.

    The walk goes in blocks of about the square root of their number, since appending to an
    array copies it.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    lengths = F.transform(matches, F.char_length)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.get(state["gaps"], i)
        end = start + F.get(state["lengths"], i)
        found = F.when(F.get(state["keep"], i), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"])
        return F.struct(end.alias("at"), found.alias("out"), state["gaps"].alias("gaps"), state["lengths"].alias("lengths"), state["keep"].alias("keep"))

    def block(state: Column, first: Column) -> Column:
        size = state["block"]
        inner = F.aggregate(
            F.sequence(first, F.least(first + size, F.size(state["lengths"])) - 1),
            F.struct(state["at"].alias("at"), empty.alias("out"), state["gaps"].alias("gaps"), state["lengths"].alias("lengths"), state["keep"].alias("keep")),
            step,
            lambda s: F.struct(s["at"].alias("at"), s["out"].alias("out")),
        )
        done = F.concat(state["out"], F.array(inner["out"]))
        return F.struct(inner["at"].alias("at"), done.alias("out"), state["gaps"].alias("gaps"), state["lengths"].alias("lengths"), state["keep"].alias("keep"), size.alias("block"))

    size = F.ceil(F.sqrt(F.size(matches))).cast("int")
    walked = F.aggregate(
        F.sequence(F.lit(0), F.size(matches) - 1, size),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"), gaps.alias("gaps"), lengths.alias("lengths"), keep.alias("keep"), size.alias("block")),
        block,
        lambda s: F.flatten(s["out"]),
    )
    return F.when(F.size(matches) > 0, walked).otherwise(empty)


def _assigned(match: Column) -> Column:
    """The value of an assignment."""
    return F.regexp_extract(match, ASSIGN_VALUE, 1)


def _codes(token: Column) -> Column:
    """The characters' codes, in one pass over the token."""
    return F.transform(F.split(token, "", -1), lambda c: F.least(F.ascii(c), F.lit(_CHARS - 1)))


def labelled_samples(docs: DataFrame, documents: int = 20_000, generated: int = 2_000) -> DataFrame:
    """``token`` and ``is_random`` for training; ``generated`` digests and as many compounds of listed words."""
    own = id_and_text(docs)
    every = max(1, -(-own.select("doc_id").count() // documents))
    texts = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    hits = F.concat(
        F.transform(F.expr(f"regexp_extract_all(text, {_literal(ASSIGN)}, 0)"), _assigned),
        F.expr(f"regexp_extract_all(text, {_literal(ACCESS)}, 0)"),
        F.expr(f"regexp_extract_all(text, {_literal(HEX)}, 0)"),
    )
    found = texts.select(F.explode(hits).alias("token")).filter(F.char_length("token") >= 12).withColumn("is_random", F.lit(True))
    # What no base pattern hits.
    rest = texts.select(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    plain = rest.select(F.explode(F.expr(f"regexp_extract_all(text, {_literal('[A-Za-z0-9+/_=-]{8,}')}, 0)")).alias("token"))
    plain = plain.filter(~_plainly_random(F.col("token")))
    words = rest.select(F.expr("regexp_extract_all(text, '[A-Za-z]{2,}', 0)").alias("words"))
    # Three of every twelve words, so that compounds and words of the text weigh about the same.
    starts = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3, F.lit(12)))
    of_texts = words.select(F.explode(F.transform(starts, lambda i: F.struct(*[F.get("words", i + j).alias(w) for j, w in enumerate("abc")]))).alias("w"))

    ids = docs.sparkSession.range(generated)
    listed = F.from_json(F.lit(json.dumps(_WORDS)), "array<string>")
    of_list = ids.select(*[F.get(listed, F.pmod(F.xxhash64("id", F.lit(j)), F.lit(len(_WORDS))).cast("int")).alias(w) for j, w in enumerate("abc")])
    compounds = _compounds(of_texts.select("w.*").unionByName(of_list))
    ordinary = plain.unionByName(compounds).withColumn("is_random", F.lit(False))
    digest = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    made = ids.select(F.when(F.col("id") % 2 == 0, digest).otherwise(F.translate(digest, "+/", "-_")).alias("token"), F.lit(True).alias("is_random"))
    return found.unionByName(ordinary).unionByName(made)


def _plainly_random(token: Column) -> Column:
    """Whether more than a third of the steps change between letters, digits and case."""
    return 3 * F.size(F.split(token, _CHANGE, -1)) - 3 > F.char_length(token)


def _compounds(words: DataFrame) -> DataFrame:
    """The three words ``a``, ``b``, ``c`` of each row as one ``token``, in a form and with numbers chosen by their hash."""
    turn = F.xxhash64("a", "b", "c")
    number = F.pmod(F.shiftright("turn", 8), F.lit(9000)).cast("int")
    form = F.get(F.from_json(F.lit(json.dumps(_FORMS)), "array<string>"), F.pmod("turn", F.lit(len(_FORMS))).cast("int"))
    two = lambda n: F.lpad((number % n + 1).cast("string"), 2, "0")
    parts = {"{year}": (1000 + number).cast("string"), "{month}": two(12), "{day}": two(31), "{digit}": (number % 10).cast("string")}
    parts["{U}"] = F.upper(F.substring("c", 1, 4))
    for w in "abc":
        parts |= {f"{{{w}}}": F.lower(w), f"{{{w.upper()}}}": F.initcap(w)}
    token = F.col("token")
    for name, value in parts.items():
        token = F.replace(token, F.lit(name), value)
    made = words.withColumn("turn", turn).withColumn("token", form)
    return made.select(F.when(F.pmod("turn", F.lit(7)) == 0, F.upper(token)).otherwise(token).alias("token"))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def train(samples: DataFrame) -> list[int]:
    """The table of log ratios: row of the character before (or the start), column of the character, in thousandths."""
    coded = samples.filter(F.col("token").isNotNull() & (F.col("token") != "") & F.col("is_random").isNotNull()).select("is_random", _codes(F.col("token")).alias("codes"))
    # The last element of a split by nothing is empty and has code 0.
    pairs = coded.select("is_random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(_START)), F.col("codes")).alias("a"), F.col("codes").alias("b"))).alias("p"))
    counted = pairs.filter("p.b > 0").groupBy("is_random", "p.a", "p.b").agg(F.count("*").alias("n"))
    counts = {True: [[0.0] * _CHARS for _ in range(_START + 1)], False: [[0.0] * _CHARS for _ in range(_START + 1)]}
    for r in counted.collect():
        counts[r.is_random][r.a][r.b] += r.n

    def logs(table: list[list[float]]) -> list[list[float]]:
        # A pair's share leans on how common its second character is, and that on nothing.
        whole = [sum(row[b] for row in table) + 0.5 for b in range(_CHARS)]
        total = sum(whole)
        base = [w / total for w in whole]
        return [[math.log((row[b] + 20 * base[b]) / (sum(row) + 20)) for b in range(_CHARS)] for row in table]

    random, ordinary = logs(counts[True]), logs(counts[False])
    return [round(1000 * min(x - y, _MOST)) for r, o in zip(random, ordinary) for x, y in zip(r, o)]


def _is_sign(code: Column) -> Column:
    return code.isin(*map(ord, "+/_=-"))


def _ratio(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token, in thousandths."""
    start = F.struct(F.lit(_START).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, c: Column) -> Column:
        ratio = F.get(table, s["last"] * _CHARS + c)
        # However long a run of one character or a rule of signs is, it does not add up to a secret.
        plain = (c == s["last"]) | (_is_sign(c) & _is_sign(s["last"]))
        return F.struct(c.alias("last"), (s["sum"] + F.when(plain, F.least(ratio, F.lit(0))).otherwise(ratio)).alias("sum"))

    return F.aggregate(
        _codes(token), start,
        lambda s, c: F.when(c == 0, s).otherwise(step(s, c)),
        lambda s: s["sum"],
    )


def scan(docs: DataFrame, table: list[int], margin: float = 8.0) -> DataFrame:
    """``row`` (the document), ``text`` without nulls, and the ``spans``: an ordered array of (start, kind, end), kinds by number."""
    whole = docs.select(F.struct("*").alias("row")).withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return _scanned(whole, table, margin)


def _scanned(texts: DataFrame, table: list[int], margin: float) -> DataFrame:
    ratios = F.from_json(F.lit(str(table)), "array<int>")
    for name, pattern in (("m0", ASSIGN), ("m1", ACCESS), ("m2", HEX), ("m3", TOKEN)):
        texts = texts.withColumn(name, F.expr(f"regexp_extract_all(text, {_literal(pattern)}, 0)"))
    keeps = (
        (0, ASSIGN, lambda m: F.char_length(_assigned(m)) >= LEAST_ASSIGNED),
        (1, ACCESS, lambda m: F.char_length(m) >= LEAST_ACCESS),
        (2, HEX, lambda m: F.lit(True)),
        (3, TOKEN, lambda m: _ratio(m, ratios) >= int(1000 * margin)),
    )
    parts = []
    for kind, pattern, keep in keeps:
        matches = F.col(f"m{kind}")
        # Where nothing is kept there is nothing to place.
        kept = F.transform(matches, keep)
        found = F.when(F.exists(matches, keep), _spans(F.col("text"), pattern, matches, kept))
        parts.append(_of_kind(F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>")), kind))
    return texts.withColumn("spans", F.array_sort(F.concat(*parts))).drop("m0", "m1", "m2", "m3")


def _of_kind(places: Column, kind: int) -> Column:
    return F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def found_secrets(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, their hash, and all spans."""
    table = train(labelled_samples(docs))
    scanned = _scanned(id_and_text(docs).withColumn("text", F.coalesce("text", F.lit(""))), table, 8.0)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select("doc_id", *map(_count, range(3)), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mask``."""

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        put = F.when(inside, F.array().cast("array<string>")).otherwise(F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], put).alias("out"))

    walked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, walked).otherwise(text)
