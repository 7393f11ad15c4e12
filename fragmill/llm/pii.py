"""Personal data by patterns, and terms that give protected entities away (DataFrame functions only).

Positions come from splitting a text at a pattern and adding up the lengths of what lies between its matches.  Only
texts that pass a cheap test meet a pattern.  The patterns are the plain ones with runs made possessive and anchored at
a run's start, so no text costs more than its length.  Running sums go by blocks of `HELD` spans, overlaps by binary
search, and texts of many spans are cut from pieces of theirs, so the spans of a long text cost in proportion.

The corpus tells which terms disclose: a term's disclosure is the share of its occurrences that stand in the context of
a protected entity (`WINDOW` words within `REACH` code points on either side), its information the logarithm of that
share over the share of all words that do.  Both are taken with each entity by itself (a nickname) and with all together
(a cue word).  That a term stands there must be no chance either: with its different contexts as draws, Chernoff's bound
on the binomial tail, times all terms (and entities) tried, is at most `CHANCE`.  `CONTEXTS` is 2, because one context is
what copies of one document give.  Terms beyond all thresholds are spans of their own and generalised.
Context counts and totals are aggregated on the map side; only totals of candidate terms are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_of, text_or_empty, written

#: Context words on either side, their reach, least contexts, share of occurrences and bits that disclose.
WINDOW, REACH, CONTEXTS, DISCLOSURE, BITS = 5, 120, 2, 0.5, 4.0
#: Expected number of terms that would pass by chance in the whole corpus.
CHANCE = 0.001
#: Spans of a block; texts with more are cut from pieces of so many letters.
HELD, LENGTH = 128, 1024

# The kinds, their patterns and what each text must hold to be looked at.
KINDS = ("email", "ip", "card", "phone", "term")
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_SPACE = r"[ \t\n\x0B\f\r]"
_WORD = r"[^ \t\n\x0B\f\r]"
SPAN = "array<struct<s:int,k:int,e:int>>"


def _once(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(xs: Column, op) -> Column:
    """For each number, what `op` makes of 0 and all before it: by blocks, then the blocks' own results."""

    def run(items: Column, value) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(op(acc["at"], value(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def long(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(HELD)), lambda i: run(F.slice(v, i, F.lit(HELD)), lambda x: x))
        return _once(blocks, lambda b: F.flatten(F.zip_with(b, run(b, lambda x: x["at"])["out"], lambda x, before: F.transform(x["out"], lambda y: op(before, y)))))

    return _once(xs, lambda v: F.when(F.size(v) > HELD, long(v)).otherwise(run(v, lambda x: x)["out"]))


def _matches(text: Column, pattern: Column, kind: int, ok) -> Column:
    """Spans of the matches that `ok` accepts, in order."""

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))
        ends = _once(steps, lambda v: F.zip_with(_running(v, lambda x, y: x + y), v, lambda x, y: x + y))
        placed = F.zip_with(ends, found, lambda e, m: F.when(ok(m), F.struct((e - F.char_length(m)).alias("s"), F.lit(kind).alias("k"), e.alias("e"))))
        return F.when(F.size(found) > 0, F.filter(placed, lambda x: x.isNotNull())).otherwise(F.expr(f"cast(array() as {SPAN})"))

    return _once(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def _lengths(text: Column, spans: Column) -> Column:
    """A text of many spans in lengths of `LENGTH` letters, else none."""
    return F.when(F.size(spans) > HELD, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LENGTH}}}"), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def _cut(text: Column, lengths: Column, start: Column, size: Column) -> Column:
    """Letters of a text from `start` (from 0), from its lengths where there are some, as substr counts from the front."""
    first, last = F.floor(start / LENGTH).cast("int"), F.floor((start + size - 1) / LENGTH).cast("int")
    near = F.array_join(F.slice(lengths, first + 1, F.greatest(F.lit(1), last - first + 1)), "")
    return F.when(size <= 0, "").when(F.size(lengths) > 0, F.substr(near, start % LENGTH + 1, size)).otherwise(F.substr(text, start + 1, size))


def _overlapped(kinds: Column, x: Column) -> Column:
    """Whether a span of one of the kinds (arrays of spans in order, none over another) overlaps x."""

    def hit(spans: Column) -> Column:
        before = F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(28)))), F.lit(0), lambda n, p: F.when(F.get(spans, n + p - 1)["s"] < x["e"], n + p).otherwise(n))
        return F.coalesce(F.get(spans, before - 1)["e"] > x["s"], F.lit(False))

    return F.exists(kinds, hit)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int") + 1)),
    )
    return F.when(F.char_length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    none = F.expr(f"cast(array() as {SPAN})")
    kinds = (
        (text.contains("@"), _EMAIL, lambda m: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]"), _IP, lambda m: m.rlike(_PARTS)),
        (text.rlike(r"[0-9][ -]?[0-9]"), _CARD, _luhn),
        (text.contains("+"), _PHONE, lambda m: F.char_length(_digits(m)).between(10, 15)),
    )
    found = [F.when(may, _matches(text, F.lit(p), k, ok)).otherwise(none) for k, (may, p, ok) in enumerate(kinds)]
    return F.array_sort(F.concat(*found))


def _plain(word: Column) -> Column:
    return F.rtrim(F.lower(word), F.lit(".,;:!?"))


def disclosing_terms(docs: DataFrame, window: int = WINDOW, reach: int = REACH, contexts: int = CONTEXTS, disclosure: float = DISCLOSURE, bits: float = BITS, chance: float = CHANCE) -> DataFrame:
    """term: what discloses a protected entity in this corpus, as a written table."""
    texts = docs.select(text_or_empty(docs).alias("text"))
    inner = F.lit(rf"(?<={_SPACE}){_WORD}+(?={_SPACE})")
    near = texts.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0).withColumn("lengths", _lengths(F.col("text"), F.col("spans")))

    def beside(x: Column) -> Column:
        cut = lambda start, length: _cut(F.col("text"), F.col("lengths"), start, length)
        first = F.greatest(F.lit(0), x["s"] - reach)
        left, right = (F.regexp_extract_all(t, inner, F.lit(0)) for t in (cut(first, x["s"] - first), cut(x["e"], F.lit(reach))))
        words = F.concat(F.when(F.size(left) > window, F.slice(left, -window, window)).otherwise(left), F.slice(right, 1, window))
        return F.struct(F.xxhash64(F.lower(cut(x["s"], x["e"] - x["s"]))).alias("entity"), F.transform(words, _plain).alias("w"))

    found = near.select(F.explode(F.transform("spans", beside)).alias("x")).select("x.entity", "x.w")
    seen = found.select("entity", F.xxhash64(F.concat_ws(" ", "w")).alias("context"), F.explode("w").alias("term")).where("term <> ''")
    seen = written(seen.groupBy("term", "entity", "context").agg(F.count(F.lit(1)).alias("n")), "pii-contexts")
    inside = seen.agg(F.sum("n")).first()[0] or 0
    candidates = written(seen.groupBy("term").agg(F.sum("n").alias("near"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= contexts), "pii-candidates")
    if not inside or candidates.isEmpty():
        return candidates.select("term")
    every = texts.select(F.explode(F.split("text", F.lit(f"{_SPACE}+"))).alias("w")).select(_plain(F.col("w")).alias("term")).where("term <> ''")
    totals = every.join(candidates.select(F.col("term").alias("term"), F.lit(1).alias("hit")), "term", "left").groupBy(F.when(F.col("hit") == 1, F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("total"))
    totals = written(totals, "pii-totals")
    whole = totals.agg(F.sum("total")).first()[0]
    n_terms, n_entities = seen.select("term").distinct().count(), seen.select("entity").distinct().count()

    def telling(counts: DataFrame, tried: int) -> DataFrame:
        """Terms of counts (term, near, contexts, beside: words beside the entities) that pass."""
        k, base = F.least("contexts", "total"), F.col("beside") / F.lit(whole)  # an occurrence between two entities is one draw
        draws = k + F.greatest(F.lit(0), F.col("total") - F.col("near"))
        q, share = k / draws, F.least(F.lit(1.0), F.col("near") / F.col("total"))
        gain = q * F.log(q / base) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(0.0)
        sure = (q > base) & (draws * gain >= math.log(tried / chance))
        return counts.join(totals, "term").where((k >= contexts) & (share >= disclosure) & (F.log2(share / base) >= bits) & sure).select("term")

    together = candidates.withColumn("beside", F.lit(inside))
    each = seen.groupBy("term", "entity").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= contexts)
    each = each.join(seen.groupBy("entity").agg(F.sum("n").alias("beside")), "entity")
    told = telling(together, n_terms).union(telling(each, n_terms * n_entities)).distinct().where(F.size(base_spans(F.col("term"))) == 0)
    return written(told.select("term"), "pii-terms")


def find_personal_data(docs: DataFrame, payload: Column, terms: DataFrame | None = None) -> DataFrame:
    """payload, text and spans of each row: base spans and the disclosing terms' spans, by start, then kind."""
    terms = disclosing_terms(docs) if terms is None else terms
    rows = docs.select(payload.alias("payload"), docs["doc_id"].alias("id"), text_or_empty(docs).alias("text"))
    if terms.isEmpty():
        return rows.select("payload", "text", base_spans(F.col("text")).alias("spans"))
    words = rows.where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct(F.transform(F.split("text", F.lit(f"{_SPACE}+")), _plain))).alias("term"))
    hits = written(words.join(terms, "term", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("wanted")), "pii-hits")
    quoted = F.transform("wanted", lambda t: F.concat(F.lit("\\Q"), F.regexp_replace(t, F.lit(r"\\E"), F.lit(r"\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?iu)(?<!{_WORD})(?:"), F.array_join(F.reverse(quoted), "|"), F.lit(rf")(?=[.,;:!?]*(?:{_SPACE}|\z))"))
    more = F.when(F.col("wanted").isNotNull(), _matches(F.col("text"), pattern, KINDS.index("term"), lambda m: F.lit(True))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    joined = rows.join(hits, "id", "left").select("payload", "text", base_spans(F.col("text")).alias("base"), more.alias("more"))
    by_kind = F.array(*(F.filter("base", lambda x, k=k: x["k"] == k) for k in range(KINDS.index("term"))))
    joined = joined.withColumn("kinds", F.when(F.size("more") > 0, by_kind))
    free = F.when(F.size("more") > 0, F.filter("more", lambda x: ~_overlapped(F.col("kinds"), x))).otherwise(F.col("more"))
    return joined.select("payload", "text", F.array_sort(F.concat("base", free)).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_personal_data(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of each whole text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind.  Null text counts as empty and has no
    spans.  Every row gives a row, repeated ones too; rows of one id share the terms looked for; a null id stays null and
    has base spans only.  Texts of any length are read whole.  An empty table gives an empty one; other columns are not
    read, so their names may be any.
    """
    found = find_personal_data(docs, F.struct(docs["doc_id"]), terms)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < KINDS.index("term"))
    return found.select("payload.doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), count(4).alias("n_term"))


def sanitise(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The rows and columns of docs; in `text`, base spans become [EMAIL], [IP], [CARD], [PHONE], disclosing terms [TERM].

    Of overlapping spans the one that starts first goes in full and the rest of the others is cut off.  A null text
    stays null, an empty one empty; repeated rows stay; texts of any length are cut whole; other columns may have any
    names.
    """
    found = find_personal_data(docs, row_of(docs), terms).withColumn("before", _running(F.transform("spans", lambda x: x["e"]), F.greatest)).withColumn("lengths", _lengths(F.col("text"), F.col("spans")))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    cut = lambda start, length: _cut(F.col("text"), F.col("lengths"), start, length)
    piece = lambda x, at: F.when(x["s"] >= at, F.concat(cut(at, x["s"] - at), F.element_at(labels, x["k"] + 1))).otherwise("")
    last = F.array_max(F.transform("spans", lambda x: x["e"]))
    clean = F.concat(F.array_join(F.zip_with("spans", "before", piece), ""), cut(last, F.char_length("text") - last))
    return found.select(F.col("payload").withField("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("payload.text"))).alias("payload")).select("payload.*")
