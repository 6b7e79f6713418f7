"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed once on the driver into a Boolean trigram query: literal
runs give conjunctions of trigrams, alternatives give disjunctions, and a run that anything may stand
in for gives nothing. Texts, lower-cased, are indexed by the trigrams that some query names: postings
(trigram, key). Counting the postings of each conjunction by key intersects its lists; keys that reach the
full count are candidates, and only these are verified with the regular expression. A rule without a
mandatory trigram (the hex rule) scans every text.

Positions count code points: the pieces between matches (split) and the matches themselves
(regexp_extract_all) alternate, so their lengths add up to the starts.

Postings are keyed by id (by the text's hash where it is null). Verification is exact, so keys that
clash only add candidates. Rows are parted by a bitmap of the candidates' hashes, which has a fixed size: those it rules out
are scanned in place for the rules without a query, and only the others' texts are moved to meet their candidates.
Neither side of that join is broadcast by force, and its own exchanges let adaptive execution split a hot key.

Defined cases: a null text is an empty one, without spans; null and repeated ids stay separate rows; other columns
pass through `keep`, one called `spans` as `spans_kept`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import beside, written


@dataclass(frozen=True)
class Rule:
    """kind: its name; a match counts if `group` has at least `least` characters; base: named by the base contract. closes: a
    match reaches to the end of the next match of this pattern, if no other run of five dashes comes before it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    closes: str = ""


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: api_?key keeps its `?`; the class form of a letter works alike in every regex dialect.
KEYWORDS = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))

RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN[ A-Z]*PRIVATE KEY-----", closes=r"-----END[ A-Z]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]+:[^\s/:@]+@"),
)

#: Alternatives that a literal run may spread into before it is cut.
MOST_ALTERNATIVES = 96


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's Boolean trigram query in disjunctive form, over lower-cased text: a matching text
    holds every trigram of at least one of the sets. None: no trigram is mandatory."""
    found = _runs(re._parser.parse(pattern))
    clauses = []
    for run in found:
        sets = [trigrams(s) for s in run]
        if sets and all(sets):
            clauses.append(sets)
    if not clauses:
        return None
    whole: list[frozenset[str]] = []
    for pick in product(*clauses) if len(clauses) < 4 else [(s,) for s in clauses[0]]:
        whole.append(frozenset().union(*pick))
    least = sorted({s for s in whole if not any(o < s for o in whole)}, key=sorted)
    return least


def _runs(parsed) -> list[set[str]]:
    """Literal runs of a parsed sequence, each a set of alternatives; None elements cut runs."""
    runs: list[set[str]] = []
    now: set[str] = {""}

    def cut() -> None:
        nonlocal now
        runs.append(now)
        now = {""}

    for piece in _pieces(parsed):
        if piece is None or len(now) * len(piece) > MOST_ALTERNATIVES:
            cut()
        if piece is not None and len(piece) <= MOST_ALTERNATIVES:
            now = {a + b for a in now for b in piece}
    cut()
    return runs


def _pieces(parsed) -> list[set[str] | None]:
    """A set of strings (lower-cased) that stand at each place, or None where too much may stand there."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN":
            out.append(_characters(arg))
        elif name == "SUBPATTERN":
            out += _pieces(arg[-1])
        elif name == "BRANCH":
            sides = [_whole(_pieces(x)) for x in arg[1]]
            out.append(set().union(*sides) if all(x is not None for x in sides) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            one = _whole(_pieces(inner))
            if one is None:
                out.append(None)
            elif (low, high) == (0, 1):
                out.append({""} | one)
            else:
                out += [one] * min(low, 8)
                if low != high or low > 8:
                    out.append(None)
        elif name == "AT":
            continue
        else:
            out.append(None)
    return out


def _whole(pieces: list[set[str] | None]) -> set[str] | None:
    now = {""}
    for p in pieces:
        if p is None or len(now) * len(p) > MOST_ALTERNATIVES:
            return None
        now = {a + b for a in now for b in p}
    return now


def _characters(members) -> set[str] | None:
    out: set[str] = set()
    for op, arg in members:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 12:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 12 else None


class Index:
    """The queries of a rule set and the trigrams they name."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.terms = sorted({t for q in self.queries for s in q or () for t in s})
        #: (rule, its trigrams) of each conjunction
        self.conjunctions = [(n, s) for n, q in enumerate(self.queries) for s in q or ()]

    def postings(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(term, key): one row for each trigram of the queries that a text holds."""
        low = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
        held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(n)) for n, t in enumerate(self.terms))), lambda x: x.isNotNull())
        return low.select("key", F.explode(held).alias("term"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(key, rules): the rules whose query the key's postings satisfy."""
        place = {t: n for n, t in enumerate(self.terms)}
        uses = F.create_map(*(x for t in self.terms for x in (F.lit(place[t]), F.array(*(F.lit(c) for c, (_, s) in enumerate(self.conjunctions) if t in s)))))
        need = F.array(*(F.lit(len(s)) for _, s in self.conjunctions))
        rule = F.array(*(F.lit(n) for n, _ in self.conjunctions))
        met = (
            postings.distinct()
            .select("key", F.explode(F.element_at(uses, F.col("term"))).alias("conjunction"))
            .groupBy("key", "conjunction")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == F.get(need, F.col("conjunction")))
        )
        return met.groupBy("key").agg(F.collect_set(F.get(rule, F.col("conjunction"))).alias("rules"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once: what a lambda names from outside is computed at each call of it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(values: Column) -> Column:
    """The array (bound) in blocks of about the square root of its size (one block at least)."""

    def cut(each: Column) -> Column:
        last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / each).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * each + 1, each))

    return _bound(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int")), cut)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What the fold of the values with `step`, from 0, has reached before each of them (all int).

    A fold that appends copies its array each time, which is quadratic; so each block of the square root of the size is folded
    by itself, from what the blocks before it reach."""

    def within(block: Column, begin: Column) -> Column:
        kept = F.aggregate(
            block, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )
        return kept["out"]

    def folded(blocks: Column) -> Column:
        reach = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
        return F.flatten(F.zip_with(blocks, within(reach, F.lit(0)), within))

    return _bound(values, lambda v: _bound(_blocks(v), folded))


def dashed(rule: Rule) -> str:
    """All that matters to a rule that closes, as one pattern: dashes and (1) a match, after (2) dashes more than its own; dashes
    and (3) what closes it; any other five dashes. A body of any length, with shorter runs of dashes, lies between two of these."""
    return f"((-*){rule.pattern})|(-*{rule.closes})|-{{5,}}"


def _closed_spans(text: Column, rule: Rule) -> Column:
    """_spans of a rule that closes: each match is paired with what follows it."""
    p, span = dashed(rule), "array<struct<start: int, end: int>>"
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(group)), F.length)
    found = F.arrays_zip(F.transform(F.split(text, p, -1), F.length).alias("gap"), lengths(0).alias("m"), lengths(1).alias("opens"), lengths(2).alias("more"), lengths(3).alias("closes"))
    found = F.filter(found, lambda x: x["m"].isNotNull())

    def placed(all_: Column) -> Column:
        before = running(F.transform(all_, lambda x: x["gap"] + x["m"]), lambda a, x: a + x)
        return F.zip_with(all_, before, lambda x, at: F.struct(
            (x["opens"] > 0).alias("opens"), (x["closes"] > 0).alias("closes"), (at + x["gap"] + x["more"]).alias("start"), (at + x["gap"] + x["m"]).alias("end")
        ))

    def paired(all_: Column) -> Column:
        following = F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
        both = F.zip_with(all_, following, lambda x, y: F.struct(x["opens"].alias("opens"), x["start"].alias("start"), F.when(y["closes"], y["end"]).otherwise(x["end"]).alias("end")))
        return F.transform(F.filter(both, lambda x: x["opens"]), lambda x: F.struct(x["start"], x["end"]))

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), _bound(_bound(found, placed), paired).cast(span)).otherwise(F.array().cast(span))


def _spans(text: Column, rule: Rule) -> Column:
    """All counted matches as array<struct<start, end>> in code points, in order."""
    if rule.closes:
        return _closed_spans(text, rule)
    p, span = F.lit(rule.pattern), "array<struct<start: int, end: int>>"
    matches = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("m"),
        F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length).alias("g"),
    )
    # What follows the last match has no match of its own.
    matches = F.filter(matches, lambda x: x["m"].isNotNull())

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + x["m"]), lambda a, x: a + x)
        return F.zip_with(found, before, lambda x, at: F.struct(x["g"].alias("g"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["m"]).alias("end")))

    counted = F.transform(F.filter(_bound(matches, placed), lambda x: x["g"] >= rule.least), lambda x: F.struct(x["start"], x["end"]))
    return F.when(F.regexp_like(text, p), counted.cast(span)).otherwise(F.array().cast(span))


#: Words of 64 bits that tell which keys may be candidates: what is broadcast, whatever the corpus.
MARK_WORDS = 1 << 16


def _mark(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(MARK_WORDS)).cast("int"), F.pmod(F.shiftright(h, 16), F.lit(64)).cast("int")


def _apart(rows: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be a candidate's, all others). A bit for each candidate's hash, in at most MARK_WORDS words, is
    broadcast; so only texts that may need the join are shuffled, and of others as many as share a bit by chance."""
    word, bit = _mark(F.col("key"))
    marks = candidates.withColumns({"word": word, "bit": bit}).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"))
    told = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word", "left")
    may = F.coalesce(F.expr("shiftright(marks, bit)").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return told.where(may).select(*rows.columns), told.where(~may).select(*rows.columns)


def secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The kept columns (the id unless named) and `spans`: all matches as array<struct<start, order, end, kind>>,
    by start, then in the order of the rules."""
    keep = [doc_id] if keep is None else list(keep)
    index = Index(rules)
    rows = df.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    rows = rows.withColumn("key", F.coalesce("id", F.xxhash64("body")))
    candidates, _ = written(index.candidates(index.postings(rows, "key", "body")), "candidates")
    maybe, others = _apart(rows, candidates)
    none = F.array().cast("array<struct<start: int, end: int>>")

    def scanned(found: DataFrame, wanted: Callable[[int], Column] | None) -> DataFrame:
        """wanted: whether a rule's query is met; without it only rules without a query are tried."""
        each = []
        for n, (r, q) in enumerate(zip(index.rules, index.queries, strict=True)):
            s = _spans(F.col("body"), r)
            each.append((s if q is None else none if wanted is None else F.when(wanted(n), s).otherwise(none)).alias(f"s{n}"))
        found = found.select(*(f"k{n}" for n in range(len(keep))), *each)
        named = [_named(F.col(f"s{n}"), n, r.kind) for n, r in enumerate(index.rules)]
        return found.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(beside(keep, ["spans"]))), F.array_sort(F.concat(*named)).alias("spans"))

    met = scanned(maybe.join(candidates, "key", "left"), lambda n: F.array_contains("rules", F.lit(n)))
    return met.union(scanned(others, None))


def _named(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (overlaps merged) replaced by mark; spans: by start.

    What stays are the pieces from the furthest end so far to a start beyond it. As finding a place in a text reads it
    from its start, the text is first cut into runs of pieces, and these into the pieces."""
    furthest = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    gaps = F.zip_with(furthest, spans, lambda m, s: F.struct(m.alias("from"), s["start"].alias("to")))
    gaps = F.filter(gaps, lambda g: g["to"] >= g["from"])
    cut = lambda t, begin, g: F.substring(t, g["from"] - begin + 1, g["to"] - g["from"])

    def run(block: Column) -> Column:
        begin, end = F.element_at(block, 1)["from"], F.element_at(block, -1)["to"]
        whole = F.substring(text, begin + 1, end - begin)
        return _bound(begin, lambda b: _bound(whole, lambda t: F.array_join(F.transform(block, lambda g: F.concat(cut(t, b, g), F.lit(mark))), "")))

    rest = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    done = F.concat(F.array_join(_bound(gaps, lambda g: F.transform(_blocks(g), run)), ""), F.substring(text, rest + 1, F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def without_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with each secret in its text replaced; all rows and columns stay."""
    found = secrets(df, doc_id, text, df.columns, rules.__class__(rules))
    spans = "__spans"
    found = found.toDF(*df.columns, spans)
    out = found.withColumn(text, redacted(F.col(f"`{text}`"), F.col(spans)))
    return out.select(*(f"`{c}`" for c in df.columns))
