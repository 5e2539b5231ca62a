r"""Personal data by rules and by bootstrapped context, with DataFrame functions only.

Base entities are leftmost, non-overlapping matches of fixed rules. Matches and the
pieces between them come from one pattern each (``regexp_extract_all`` and ``split``);
positions are running sums of their lengths. The patterns below are written so that
Java needs neither recursion nor a second look at a run of characters: quantifiers
are possessive, and a match may only begin where a run begins or the last match ended.

Bootstrapping: base entities and keys of well-known formats (kind ``secret``) are the
seeds. Every other run of letters, digits and ``_+/.-`` with a digit is a candidate.
Lexical patterns are the one, two and three words before a value; a further feature is
the alphabet of a long value that mixes letters and digits. Instances (distinct values)
and their patterns are a bipartite graph: a pattern's score is the mean score of its
instances, smoothed; an instance's score is the noisy-or of its patterns' scores, a
seed's is 1. So the words before the seeds score first, then the alphabets of the seeds,
then other words before values of those alphabets. After a few rounds, lexical patterns
over ``accept`` whose instances score ``support`` or more in all discover: every candidate
behind one is a span of kind ``context``, whatever its form.

Defined results: a null or empty text has no spans; rows that repeat a document with
its text get the same spans; a null id is kept; candidates that meet a base entity or a
secret are no spans; an empty table gives no rows; other columns, whatever their names,
are ignored (``redact`` keeps them). Positions are code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fresh
from plumbline.sources.shared import broadcast_if_small, drop_table, work_table

KINDS = ("email", "ip", "card", "phone", "secret", "context")

#: Fixed rules, equal in effect to those of the contract.
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+ of 14 digits or more            phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Public formats: access key ids, and tokens of 40 hexadecimal digits.
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_+/.-])[A-Za-z_+/.-]*+[0-9](?:[_+/.-]*+[A-Za-z0-9]++)*+",
}

#: What a text must contain for the pattern to be tried.
CUES = {"email": "@", "phone": "+"}


@dataclass(frozen=True)
class PiiParams:
    """Rounds and thresholds of the bootstrapping; ``most_rows`` bounds the tables of spans and of patterns that are broadcast."""

    rounds: int = 4
    prior: float = 1.0
    accept: float = 0.9
    support: float = 5.0
    most_rows: int = 200_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 0, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match counts as an entity of its kind."""
    n = F.length(_digits(value))
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _flat(text: Column) -> Column:
    """A text with a space for each white space."""
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def matches(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """``doc_id, h, kind, start, end, value, before`` of every match of the patterns.

    ``h`` is a hash of the text: together with the id it names a row's content. ``before``
    are the three words before the match, with their spaces.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("t"))

    def values(kind: str) -> Column:
        found = F.regexp_extract_all("t", F.lit(PATTERNS[kind]), 0)
        return F.when(F.contains("t", F.lit(CUES[kind])), found) if kind in CUES else found

    got = got.withColumns({f"v_{k}": values(k) for k in kinds})
    # What stands between the matches is only looked for where there are any.
    both = [F.when(F.size(f"v_{k}") > 0, F.struct(F.lit(k).alias("kind"), F.col(f"v_{k}").alias("values"), F.split("t", PATTERNS[k], -1).alias("pieces"))) for k in kinds]
    rows = got.select("doc_id", "h", F.explode(F.filter(F.array(*both), lambda x: x.isNotNull())).alias("m"))
    near = F.transform(F.col("m.pieces"), lambda p: F.struct(F.length(p).alias("n"), F.substring_index(F.rtrim(_flat(p)), " ", -3).alias("words"), F.endswith(_flat(p), F.lit(" ")).alias("apart")))
    slim = rows.select("doc_id", "h", "m.kind", F.col("m.values").alias("values"), near.alias("near"))
    each = F.transform(F.sequence(F.lit(1), F.size("values")), lambda i: F.struct(F.element_at("values", i).alias("value"), F.element_at("near", i).alias("left")))
    out = slim.select("doc_id", "h", "kind", F.posexplode(each).alias("k", "x"))
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # Equal rows are one content: their matches coincide.
    once = out.dropDuplicates(["doc_id", "h", "kind", "k"])
    end = F.sum(F.col("x.left.n") + F.length("x.value")).over(before)
    words = F.concat("x.left.words", F.when(F.col("x.left.apart"), F.lit(" ")).otherwise(F.lit("")))
    placed = once.select("doc_id", "h", "kind", end.cast("long").alias("end"), F.col("x.value").alias("value"), words.alias("before"))
    return placed.withColumn("start", F.col("end") - F.length("value"))


def base_entities(found: DataFrame) -> DataFrame:
    """The matches of the four rules that count, and secrets."""
    keep = F.col("kind") == "secret"
    for kind in KINDS[:4]:
        keep = keep | ((F.col("kind") == kind) & _holds(kind, F.col("value")))
    return found.where(keep)


def _alphabet(value: Column) -> Column:
    """The alphabet of a value of 12 characters or more that mixes letters and digits; else null."""
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.length(value) >= 12)
    kinds = (("hex", "^[0-9a-f]+$"), ("upper", "^[0-9A-Z]+$"), ("mixed", "^[0-9A-Za-z_+/-]+$"))
    found = F.coalesce(*[F.when(F.rlike(value, F.lit(p)), F.lit(f"S|{name}")) for name, p in kinds])
    return F.when(mixed, found)


def _named(pattern: Column) -> Column:
    """A pattern's text, or a digest where it is long."""
    return F.when(F.length(pattern) <= 64, pattern).otherwise(F.concat(F.substr(pattern, F.lit(1), F.lit(3)), F.sha2(pattern, 256)))


def lexical(before: Column) -> Column:
    """Patterns of one, two and three words before a value, digits made equal, with the space at their end; none without words."""
    words = F.regexp_replace(F.lower(before), "[0-9]", "0")
    tail = F.when(F.endswith(words, F.lit(" ")), F.lit(" ")).otherwise(F.lit(""))
    body = F.rtrim(words)
    made = F.array(*[_named(F.concat(F.lit(f"L{k}|"), F.substring_index(body, " ", -k), tail)) for k in (1, 2, 3)])
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def instances(found: DataFrame, base: DataFrame) -> DataFrame:
    """Seeds and candidates with their patterns; candidates that meet a base entity are left out."""
    cols = ["doc_id", "h", "kind", "start", "end", "value", "before"]
    taken = base.select(F.col("doc_id").alias("bd"), F.col("h").alias("bh"), F.col("start").alias("bs"), F.col("end").alias("be"))
    same = F.col("doc_id").eqNullSafe(F.col("bd")) & (F.col("h") == F.col("bh"))
    free = found.where("kind = 'token'").join(taken, same & (F.col("start") < F.col("be")) & (F.col("bs") < F.col("end")), "left_anti")
    rows = base.select(*cols).unionByName(free.select(*cols)).withColumn("seed", F.col("kind") != "token")
    shape = F.filter(F.array(_alphabet(F.col("value"))), lambda x: x.isNotNull())
    return rows.select("doc_id", "h", "start", "end", "value", "seed", F.concat(lexical(F.col("before")), shape).alias("patterns"))


def score_patterns(rows: DataFrame, params: PiiParams) -> DataFrame:
    """``pattern, score, mass`` after the rounds, on the graph of distinct values and patterns; ``mass`` sums the instances' scores."""
    edges = work_table(rows.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.select("value", "pattern", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("s"))
    patterns = last = None
    for k in range(params.rounds):
        if patterns is not None:
            drop_table(patterns)
        summed = scores.groupBy("pattern").agg((F.sum("s") / (F.count("*") + params.prior)).alias("score"), F.sum("s").alias("mass"))
        # Only patterns that the seeds reached so far say anything.
        patterns = work_table(summed.where("mass > 0"), "patterns")
        if k + 1 == params.rounds:
            break
        told = edges.join(broadcast_if_small(patterns.select("pattern", "score"), params.most_rows), "pattern")
        reached = told.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("got"))
        new = work_table(edges.join(reached, "value", "left").select("value", "pattern", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("got", F.lit(0.0))).alias("s")), "scores")
        if last is not None:
            drop_table(last)
        last = scores = new
    for t in (edges, last):
        if t is not None:
            drop_table(t)
    return patterns


def find_pii(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``doc_id, h, kind, start, end`` of base entities, secrets and of discovered spans (kind ``context``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = work_table(matches(docs, [*KINDS[:5], "token"]), "matches")
    base = base_entities(found)
    rows = work_table(instances(found, base), "instances")
    good = score_patterns(rows, params).where((F.col("score") >= params.accept) & (F.col("mass") >= params.support) & F.startswith("pattern", F.lit("L")))
    open_rows = rows.where("not seed").select("doc_id", "h", "start", "end", F.explode("patterns").alias("pattern"))
    chosen = broadcast_if_small(good.select("pattern"), params.most_rows)
    new = open_rows.join(chosen, "pattern", "left_semi").select("doc_id", "h", F.lit("context").alias("kind"), "start", "end").distinct()
    return base.select("doc_id", "h", "kind", "start", "end").unionByName(new)


def spans_by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row's id with its sorted spans: ``array<struct<start, rank, end>>``; rank is the kind's place in KINDS."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    grouped = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end"))).alias("spans"))
    return grouped.select(F.col("doc_id").alias("sd"), F.col("h").alias("sh"), "spans")


def attach(docs: DataFrame, grouped: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with the spans in a column ``name`` (empty where there are none)."""
    h, spans_type = fresh("h", docs.columns), "array<struct<start:bigint,rank:bigint,end:bigint>>"
    sd, sh, found = (fresh(c, [*docs.columns, h, name]) for c in ("sd", "sh", "found"))
    keyed = docs.withColumn(h, F.xxhash64("text"))
    named = grouped.select(F.col("sd").alias(sd), F.col("sh").alias(sh), F.col("spans").cast(spans_type).alias(found))
    joined = keyed.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(sd)) & (F.col(h) == F.col(sh)), "left")
    return joined.select(*docs.columns, F.coalesce(F.col(found), F.array().cast(spans_type)).alias(name))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, (s.rank + 1).cast("int")), s.start, s.end)), ",")


def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans go together."""
    spans = work_table(find_pii(docs, params), "spans")
    grouped = spans_by_document(docs, spans)
    own = fresh("spans", docs.columns)
    # So few spans are broadcast whatever the number in a document.
    rows = attach(docs, F.broadcast(grouped) if spans.limit(params.most_rows + 1).count() <= params.most_rows else grouped, own)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint>>")

    def keep(kept: Column, s: Column) -> Column:
        last = F.coalesce(F.element_at(F.transform(F.slice(kept, -1, 1), lambda x: x.end), 1), F.lit(0))
        return F.when(F.size(kept) == 0, F.array(s)).when(s.start >= last, F.concat(kept, F.array(s))).otherwise(
            F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.transform(F.slice(kept, -1, 1), lambda x: F.struct(x.start.alias("start"), x.rank.alias("rank"), F.greatest(x.end, s.end).alias("end"))))
        )

    apart = F.aggregate(own, empty, lambda kept, s: F.when(F.size(kept) > 0, keep(kept, s)).otherwise(F.array(s)))
    rows = rows.withColumn(own, F.when(F.size(own) > 1, apart).otherwise(F.col(own)))
    index = F.sequence(F.lit(1), F.size(own))

    def piece(i: Column) -> Column:
        s = F.element_at(own, i)
        start = F.when(i > 1, F.element_at(own, F.greatest(i - 1, F.lit(1))).end).otherwise(0)
        return F.concat(F.substr("text", (start + 1).cast("int"), (s.start - start).cast("int")), F.element_at(kinds, (s.rank + 1).cast("int")))

    tail = F.substr(F.col("text"), (F.element_at(own, -1).end + 1).cast("int"), F.length("text"))
    clean = F.when(F.size(own) > 0, F.concat(F.array_join(F.transform(index, piece), ""), tail)).otherwise(F.col("text"))
    return rows.withColumn("text", clean).select(*docs.columns)
