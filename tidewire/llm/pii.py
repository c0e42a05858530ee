"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

Fixed patterns find the base spans: e-mail and IP addresses, card and phone numbers.
They are the seeds of a bootstrap.  The words before a seed are a lexical pattern of its
kind; whatever else looks like an identifier (a token with a digit or @, or groups of
digits with single blanks between them) is a candidate.
Patterns and the strings that they introduce form a weighted graph, on which confidence
is passed to and fro: a pattern is as reliable as the share of all its occurrences in
the corpus that introduce known identifiers, and a string is an identifier unless all
patterns that introduce it fail.  Strings of high confidence are instances like the seeds:
in the next round the other words that introduce them become patterns, too.  Patterns of
high confidence finally add the candidates that they introduce.

Positions come from splitting a text by the pattern that was extracted from it: the
lengths of what lies between and of the matches add up.  Regular expressions are linear:
separators inside chains are first replaced by a mark of the same length, so no group
repeats, and runs are only tried from their start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, materialise, maybe_in, text_of

SPANS = "array<struct<s:int,k:int,e:int>>"
KINDS = ("email", "ip", "card", "phone")
#: Stands for a separator inside a chain; a text's own such characters are replaced first.
MARK, OTHER = "\ue000", "\ue001"

#: Distinct strings of one kind that a pattern must introduce; confidence that patterns and strings must have; added to a pattern's occurrences; rounds at most.
SUPPORT, CONFIDENT, PRIOR, ROUNDS = 3, 0.6, 1.0, 4
#: A pattern's words are of this length at most.
MOST = 128

_BLANK = r"\x20\x09-\x0D"
#: Whatever looks like an identifier: 3 characters or more with a digit or @; marks around it don't belong to it.
_PART = "A-Za-z0-9@._%+()/-"
_END = "[A-Za-z0-9@_%+/-]"
CANDIDATE = rf"(?<![{_PART}])\(*+(?=[A-Za-z._%+()/-]*+[0-9@])[A-Za-z0-9+][{_PART}]+[A-Za-z0-9](?!{_END})"
#: A blank between two groups of digits, and identifiers of several such groups, with MARK for the blank.
GAP = r"(?<=[0-9]\)?)\x20(?=\(?[0-9])"
CHAIN = rf"(?<![{_PART}])[(+]*+[0-9][0-9().{MARK}-]+[0-9](?!{_END})"
#: Matches whose places are added up in one array at a time.
RUN = 256


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,v:string>>")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>>: the matches of a pattern with their places in code points, end exclusive.

    Lengths are added up in runs, so that a text with very many matches costs no square of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    zipped = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("v")))

    def places(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(RUN)), lambda i: F.slice(all_, i, RUN))
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
        first = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda i: F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda a, x: a + x))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v")))).alias("out"))

        def run(r: Column, at: Column) -> Column:
            return F.aggregate(r, F.struct(at.alias("at"), _none().alias("out")), step, lambda acc: acc["out"])

        return F.flatten(F.zip_with(runs, first, run))

    return F.when(F.size(found) > 0, places(zipped)).otherwise(_none())


def _marked(text: Column, separator: str) -> Column:
    """Separators of a chain as MARK; the text's own marks become a character that no pattern has."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    return F.regexp_replace(clean, separator, MARK)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _above_255(part: Column) -> Column:
    """Whether the digits of a part of an IP address, which may be zeros and very many, say more than 255."""
    rest = F.ltrim(part, F.lit("0"))
    return (F.length(rest) > 3) | (F.coalesce(F.substring(rest, 1, 3).try_cast("int"), F.lit(0)) > 255)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, at(i)).when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i)),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v>> of the base spans of all kinds, in order of start, then kind."""
    local, label = rf"A-Za-z0-9._%+{MARK}-", "A-Za-z0-9-"
    dots = _marked(text, rf"(?<=[{label}])\.(?=[{label}])")
    email = matches(dots, rf"(?:\G|(?<![{local}]))[{local}]++@[{label}]++{MARK}[{label}{MARK}]++")
    ip = matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    ip = F.filter(ip, lambda x: ~F.exists(F.split(x["v"], r"\."), _above_255))
    card = matches(_marked(text, r"(?<=[0-9])[\x20-](?=[0-9])"), rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]++")
    card = F.filter(card, lambda x: F.when(F.length(_digits(x["v"])).between(12, 19), _luhn(_digits(x["v"]))).otherwise(False))
    phone = F.filter(matches(text, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: F.length(_digits(x["v"])).between(9, 15))
    digit = text.rlike("[0-9]")
    when = [F.contains(text, F.lit("@")), digit & F.contains(text, F.lit(".")), digit, digit & F.contains(text, F.lit("+"))]
    found = [F.when(c, x).otherwise(_none()) for c, x in zip(when, (email, ip, card, phone))]

    def of_kind(n: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    return F.array_sort(F.concat(*(of_kind(n, x) for n, x in enumerate(found))))


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with ``put(span, end of the spans before)`` for the spans, which are in order of start.

    Spans are taken in runs, each with its part of the text, so that a text with very
    many costs no square of them.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(RUN)), lambda i: F.slice(spans, i, RUN))
    ends = F.transform(runs, lambda r: F.array_max(F.transform(r, lambda x: x["e"])))
    first = F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.coalesce(F.array_max(F.slice(ends, 1, i)), F.lit(0)))
    parts = F.zip_with(runs, first, lambda r, at: F.struct(r.alias("r"), at.alias("at"), F.substring(text, at + 1, F.array_max(F.transform(r, lambda x: x["e"])) - at).alias("part")))

    def rewrite(run: Column) -> Column:
        start = F.struct(run["at"].alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(run["part"], acc["at"] - run["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(gap, put(x, acc["at"]))).alias("out"))

        return F.aggregate(run["r"], start, step, lambda acc: F.array_join(acc["out"], ""))

    done = F.concat(F.array_join(F.transform(parts, rewrite), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _covered(text: Column, spans: Column) -> Column:
    """The text with OTHER for every character of the spans."""
    return _rewritten(text, spans, lambda x, at: F.repeat(F.lit(OTHER), x["e"] - F.greatest(at, x["s"])))


def _opened(found: Column) -> Column:
    """Matches without those brackets at their start that they don't close."""

    def step(x: Column) -> Column:
        v = x["v"]
        many = lambda c: F.length(v) - F.length(F.translate(v, c, ""))
        n = F.least(F.length(v) - F.length(F.ltrim(v, F.lit("("))), F.greatest(F.lit(0), many("(") - many(")")))
        return F.struct((x["s"] + n).alias("s"), x["e"].alias("e"), F.substring(v, n + 1, F.length(v)).alias("v"))

    return F.transform(found, step)


def with_candidates(own: DataFrame) -> DataFrame:
    """Rows with text and base, and free: array<struct<s, e, v>>, what looks like an identifier and overlaps no base span.

    These are tokens, and chains of groups of digits with single blanks between some of
    them; a token inside a chain is no candidate of its own.  What is read inside a
    lambda is a column first, so that it is computed once a row.
    """
    text, gaps = F.col("text"), F.col("gaps")
    own = own.withColumn("gaps", F.when(text.rlike(GAP), _marked(_covered(text, F.col("base")), GAP)).otherwise(F.lit("")))
    chains = F.filter(matches(gaps, CHAIN), lambda c: F.contains(c["v"], F.lit(MARK)))
    chains = F.transform(chains, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.translate(c["v"], MARK, " ").alias("v")))
    own = own.withColumn("chains", F.when(gaps != "", _opened(chains)).otherwise(_none()))
    own = own.withColumn("tokens", F.when(text.rlike("[0-9@]"), _opened(matches(text, CANDIDATE))).otherwise(_none()))
    over = lambda c: F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])) | F.exists("chains", lambda b: (b["s"] <= c["s"]) & (c["e"] <= b["e"]))
    return own.withColumn("free", F.concat("chains", F.filter("tokens", lambda c: ~over(c)))).drop("gaps", "chains", "tokens")


def _before(text: Column, at: Column) -> Column:
    """The lexical patterns at a place: the last two words, and the last alone where it is a label such as ``tel:``.

    Words are whole: one that begins before the last MOST characters is in no pattern.
    """
    back = F.when(at > MOST, MOST + 1).otherwise(at)
    tail = F.lower(F.substring(text, at - back + 1, back))
    tail = F.when(at > MOST, tail).otherwise(F.concat(F.lit(" "), tail))
    pair = F.regexp_extract(tail, rf"[{_BLANK}]({WORD}[{_BLANK}]+{WORD})[{_BLANK}]+[\"'(<]*$", 1)
    label = F.regexp_extract(tail, rf"[{_BLANK}]({WORD}[:=])[\"'(<{_BLANK}]*$", 1)
    return F.filter(F.array(F.regexp_replace(pair, rf"[{_BLANK}]+", " "), label), lambda p: p != "")


def _labels(word: Column) -> Column:
    """array<string>: every beginning of a word, of at most MOST characters, that can be its label."""
    ends = F.filter(F.sequence(F.lit(1), F.least(F.length(word), F.lit(MOST))), lambda i: F.substring(word, i, F.lit(1)).isin(":", "="))
    return F.transform(ends, lambda i: F.substring(word, F.lit(1), i))


def scan(docs: DataFrame, rows: bool = False) -> DataFrame:
    """id, doc_id, base, seen: a row a row of ``docs``, with its columns as ``row`` if asked; seen has every base span and candidate with its patterns.

    ``k`` is the kind, -1 for a candidate.  Once written, ``id`` names the row.
    """
    text = F.col("text")
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []
    own = docs.select(*row, "doc_id", text_of(docs).alias("text"), F.monotonically_increasing_id().alias("id"))
    own = own.withColumn("base", base_spans(text))
    own = with_candidates(own)
    seen = F.concat("base", F.transform("free", lambda c: F.struct(c["s"].alias("s"), F.lit(-1).alias("k"), c["e"].alias("e"), c["v"].alias("v"))))
    seen = F.transform(seen, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"), _before(text, x["s"]).alias("p")))
    base = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    return own.select("id", "doc_id", base.alias("base"), seen.alias("seen"), *(["row"] if rows else []))


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p, n): how often each of the wanted patterns occurs in all texts, whatever follows.

    What is no wanted pattern mostly fails a test against bits of fixed size; the rest
    is counted where it is, then shuffled, and joined last, so the counts are exact.
    """
    words = docs.select(F.split(F.lower(text_of(docs)), rf"[{_BLANK}]+").alias("w"))
    next_to = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("x")).select("x.a", "x.b")
    pair = F.array(F.concat_ws(" ", "a", "b"))
    both = F.when(F.contains("a", F.lit(":")) | F.contains("a", F.lit("=")), F.concat(pair, _labels(F.col("a")))).otherwise(pair)
    said = next_to.select(F.explode(both).alias("p")).where(maybe_in(F.xxhash64("p"), wanted.select(F.xxhash64("p").alias("h"))))
    return said.groupBy("p").agg(F.count("*").alias("n")).join(wanted.select("p"), "p")


def _reliable(graph: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(p, kind): the patterns of high confidence after the bootstrap over ``graph`` (p, v, n, k); None if there are none."""
    seeds = materialise(graph.where("k >= 0").groupBy("v").agg(F.max("k").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    known, total = seeds, None
    for _ in range(ROUNDS):
        sure_ones = known.where(F.col("score") >= CONFIDENT)
        kinds = graph.join(sure_ones, "v").groupBy("p", "kind").agg(F.count("*").alias("support"), F.sum("n").alias("n"))
        # A pattern has the kind of most of its known strings, ties to the first kind.
        main = kinds.groupBy("p").agg(F.max(F.struct("n", -F.col("kind"), "kind", "support")).alias("m"))
        patterns = materialise(main.where(F.col("m.support") >= SUPPORT).select("p", F.col("m.kind").alias("kind")), "patterns")
        new = patterns if total is None else patterns.join(total, "p", "left_anti")
        if not new.isEmpty():
            counts = _occurrences(docs, new)
            total = materialise(counts if total is None else counts.unionByName(total), "occurrences")
        elif total is None:
            return None
        own = materialise(graph.join(patterns.join(total.withColumnRenamed("n", "total"), "p"), "p"), "graph")

        def sure(score: DataFrame) -> DataFrame:
            """How reliable each pattern is, by the strings of its kind."""
            met = own.join(score.withColumnRenamed("kind", "of"), "v", "left")
            good = F.when(F.col("of") == F.col("kind"), F.col("n") * F.col("score")).otherwise(0.0)
            return met.groupBy("p", "kind").agg((F.sum(good) / (F.max("total") + PRIOR)).alias("sure"))

        doubt = F.sum(F.log1p(-F.least(F.col("sure"), F.lit(1 - 1e-9))))
        told = own.select("p", "v").join(sure(known), "p").groupBy("v", "kind").agg((1 - F.exp(doubt)).alias("score"))
        told = told.groupBy("v").agg(F.max(F.struct("score", -F.col("kind"), "kind")).alias("m")).select("v", "m.kind", "m.score")
        known = materialise(seeds.unionByName(told.join(seeds, "v", "left_anti")), "known")
    return sure(known).where(F.col("sure") >= CONFIDENT).select("p", "kind")


def discover(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, more): the candidates (s, k, e) that reliable patterns introduce, in order, for the rows that have some."""
    edges = scanned.select("id", F.explode("seen").alias("x")).select("id", "x.s", "x.k", "x.e", F.lower("x.v").alias("v"), F.explode("x.p").alias("p"))
    edges = materialise(edges, "introduced")
    graph = materialise(edges.groupBy("p", "v").agg(F.count("*").alias("n"), F.max("k").alias("k")), "graph")
    good = _reliable(graph, docs)
    new = edges.where("k < 0")
    new = new.limit(0).withColumn("kind", F.lit(0)) if good is None else new.join(good, "p")
    new = new.groupBy("id", "s", "e").agg(F.min("kind").alias("k"))
    return new.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("more"))


def _written(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of ``docs``.

    The counts and the digest are of the base spans; ``spans`` has those and what the
    bootstrap adds.  A null text counts as empty: no spans, the digest of an empty
    string.  Null and repeated ids are rows like any other.  Without seeds, or without
    reliable patterns, nothing is added.
    """
    own = materialise(scan(docs), "scanned")
    own = own.join(discover(docs, own), "id", "left").select("doc_id", "base", F.coalesce("more", F.array().cast(SPANS)).alias("more"))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == n)).cast("long")

    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return own.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``[EMAIL]``, and n_chars (where it is a column) set anew.

    Rows without spans come back as they were.  Overlapping spans become one, with the kind
    of the first.  Texts are read and searched once; only rows that may have spans of the
    bootstrap, by a test against bits of fixed size, are shuffled with their texts.
    """
    own = materialise(scan(docs, rows=True), "scanned")
    new = materialise(discover(docs, own), "discovered")
    own = own.select("id", "row", "base").withColumn("may", maybe_in(F.xxhash64("id"), new.select(F.xxhash64("id").alias("h"))))
    none = F.array().cast(SPANS)
    own = own.where("not may").select("row", F.col("base").alias("spans")).unionByName(
        own.where("may").join(new, "id", "left").select("row", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))
    )
    name = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k + 1)
    own = own.withColumn("done", _rewritten(F.col("row.text"), F.col("spans"), lambda x, at: F.when(x["s"] >= at, name(x["k"])).otherwise("")))
    some = F.size("spans") > 0
    changed = {"text": F.when(some, F.col("done")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(some, F.length("done").cast(kind)).otherwise(F.col("row.n_chars"))
    return own.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
