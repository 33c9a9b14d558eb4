"""Operator 7: personal data by fixed patterns and bootstrapped contextual extraction. DataFrame functions only.

1. Base: four patterns with checks (addresses' parts, Luhn, numbers of digits). Positions come from the gaps
   that split() leaves between the matches. Patterns are possessive, so they run in linear time.
2. Candidates are strings that look like identifiers (an @, six digits, or eight characters with letters and digits) and lie in no base
   match. Each may be of the kinds whose wider SHAPES it has. A candidate of 16 characters or more that is assigned to a credential's
   name is a seed of a fifth kind, secret; base matches are the seeds of the other four.
3. Lexical patterns of a seed or candidate: its last one, two and three words before, first one and two words after, and one on either side; in
   lower case, numbers as 0, whatever their length. Patterns and instances are kept as 64-bit hashes.
4. On the graph of patterns and distinct instances, a pattern's confidence for a kind is the lower bound of Wilson's interval of its share of
   instances of that kind: scores count as far as they go, instances that cannot be of the kind count against it, and open ones by half of what they
   lack. Seeds score 1. A candidate's score is that of its best pattern on both sides, or the noisy or of its best ones on the left
   and on the right; words after it alone say nothing, nor do patterns below SURE. ROUNDS rounds, in which what was found supports further patterns.
5. Candidates with a score of ACCEPT or more become spans; numbers and addresses only where they stand in a pattern that is sure itself.

The texts are read once; the table written from that pass has a row for each document, without its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
#: The contract's patterns in possessive form. A match may start at the end of the last one (\\G) or where a run starts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
#: Candidates: a word around an @; a word of eight characters and more with letters and digits; groups of hexadecimal digits with colons; a
#: national telephone number; six digits and more with marks between.
CANDIDATE = (
    r"(?<![^\s<>\"'(),;:])[^\s@<>\"'(),;:]++@[^\s@<>\"'(),;:!?]++"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{8,}+"
    r"|(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}+:){2,7}+[0-9A-Fa-f:]*+"
    r"|(?<![\p{L}0-9+.-])(?:\([0-9]{2,4}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])"
    r"|(?<![\p{L}0-9+])[0-9](?:[().:/_-]{0,2}+[0-9]){5,}+"
)
#: Shapes that a candidate must have to be taken for a kind; cards and telephone numbers are checked by their digits, too.
SHAPES = {
    "email": r"^[^@]+@[^@]*\p{L}",
    "ip": r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^(?=.*::)[0-9A-Fa-f:]{4,}$|^[0-9]{1,3}(?:[-_][0-9]{1,3}){3}$",
    "card": r"^[0-9().:/_-]+$",
    "phone": r"^[0-9().\x20/_-]+$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{8,}$",
}
#: Words before a seed of the kind secret, as they end in front of it.
SECRET_BEFORE = r"(?i)(?:password|passwd|passphrase|pwd|secret|token|bearer|credentials?|(?:api|access|private|auth|secret)[\x20_-]?key)[\"'`]?\x20?(?:=|:|=>|:=)?\x20?[\"'`]?$"
SECRET_CHARS = 16
#: Rounds; what a pattern must be sure of to count; what a candidate must score; z of the interval's one-sided 90 percent.
ROUNDS, SURE, ACCEPT, Z2 = 3, 0.6, 0.7, 1.642
#: With fewer instances, the bound stays below SURE: n / (n + Z2) at most.
LEAST = 3


def _digits(x: Column) -> Column:
    return F.translate(x, " ().-+:/_", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _may(x: Column) -> Column:
    """The kinds whose shape x has, as bits."""
    out = F.lit(0)
    for k, kind in enumerate(ALL_KINDS):
        has = x.rlike(SHAPES[kind])
        if kind == "card":
            has &= _valid("card", x)
        if kind == "phone":
            has &= F.length(_digits(x)).between(7, 15)
        out += F.when(has, F.lit(1 << k)).otherwise(F.lit(0))
    return out


_FOUND = "array<struct<s:bigint,e:bigint,m:string,left:array<string>,right:array<string>>>"
#: Items of an array that are summed or searched one by one.
BLOCK = 128
_WS = "[\\x20\\x09-\\x0D]++"
#: What of a candidate's end is no part of it.
_TAIL = ".!?#*$%&|-"


def _words(x: Column, n: int) -> Column:
    """The first n words of x in lower case, numbers as 0."""
    all_ = F.split(F.regexp_replace(F.lower(F.btrim(x, F.lit(common.SPACE))), "[0-9]++", "0"), _WS, n + 1)
    return F.slice(F.filter(all_, lambda w: w != ""), 1, n)


def _let(x: Column, of) -> Column:
    """of(x), with x computed once."""
    return F.get(F.transform(F.array(x), of), 0)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Every match with its start, end, itself, and the words on either side: three before, nearest first, and two after.

    A match starts at the sum of the lengths before it: those of whole blocks of matches, then those within its own."""
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(m.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h")),
        lambda x: F.struct(
            F.coalesce(F.length(x["m"]), F.lit(0)).cast("long").alias("n"),
            F.length(x["g"]).cast("long").alias("skip"),
            x["m"].alias("m"),
            F.when(x["m"].isNotNull(), F.transform(_words(F.reverse(x["g"]), 3), lambda w: F.reverse(w))).alias("left"),
            F.when(x["m"].isNotNull(), _words(x["h"], 2)).alias("right"),
        ),
    )

    def placed(p: Column, lengths: Column, before: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            s = F.get(before, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK)) + x["skip"]
            return F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))

        return F.filter(F.transform(p, one), lambda x: x["m"].isNotNull())

    def blocks(p: Column, lengths: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda at: _sum(F.slice(lengths, at, BLOCK)))
        before = _let(totals, lambda t: F.transform(t, lambda _, k: _sum(F.slice(t, 1, k))))
        return _let(before, lambda b: placed(p, lengths, b))

    found = _let(parts, lambda p: _let(F.transform(p, lambda x: x["skip"] + x["n"]), lambda lengths: blocks(p, lengths)))
    return F.when(text.rlike(needs) & text.rlike(pattern), found).otherwise(F.expr(f"CAST(array() AS {_FOUND})"))


def _patterns(x: Column) -> Column:
    """The lexical patterns of a match: side (0 left, 1 right, 2 both) and hash of each."""

    def one(side: int, kind: str, have: Column, *words: Column) -> Column:
        return F.when(have, F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(kind), *words).alias("id")))

    left, right = x["left"], x["right"]
    nl, nr = F.size(left), F.size(right)
    near = [F.get(left, i) for i in range(3)]
    every = F.array(
        one(0, "l1", nl >= 1, near[0]),
        one(0, "l2", nl >= 2, near[0], near[1]),
        one(0, "l3", nl >= 3, *near),
        one(1, "r1", nr >= 1, F.get(right, 0)),
        one(1, "r2", nr >= 2, F.get(right, 0), F.get(right, 1)),
        one(2, "b", (nl >= 1) & (nr >= 1), near[0], F.get(right, 0)),
    )
    return F.filter(every, lambda p: p.isNotNull())


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _checked(kind: str):
    return lambda x: _valid(kind, x["m"])


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _sighting(kind: int | None):
    """A match as a node of the graph: its kind if it is a seed, the kinds it may be of, a hash of itself, its patterns and place."""

    def of(x: Column) -> Column:
        m = x["m"] if kind is not None else F.rtrim(x["m"], F.lit(_TAIL))
        may = F.lit(1 << kind) if kind is not None else _may(m)
        seed = F.lit(kind)
        if kind is None:
            before = F.array_join(F.reverse(x["left"]), " ")
            is_secret = (F.length(m) >= SECRET_CHARS) & before.rlike(SECRET_BEFORE) & may.bitwiseAND(F.lit(1 << ALL_KINDS.index(SECRET))).cast("boolean")
            seed = F.when(is_secret, F.lit(ALL_KINDS.index(SECRET)))
        return F.struct(seed.cast("int").alias("kind"), may.cast("int").alias("may"), F.xxhash64(F.lower(m)).alias("instance"), _patterns(x).alias("patterns"), x["s"].alias("s"), (x["s"] + F.length(m)).alias("e"), F.lit(kind is not None).alias("base"))

    return of


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _by_kind(of) -> Column:
    """The spans of every base kind, kinds in their order."""
    return F.concat(*[F.transform(of(k), _span(k)) for k in KINDS])


def _apart(some: Column, base: Column) -> Column:
    """Those of some, in their order, that overlap none of base; base is searched once for each block of some."""

    def meets(s: Column, e: Column):
        return lambda b: (b["s"] < e) & (b["e"] > s)

    def block(c: Column) -> Column:
        near = F.filter(base, meets(F.get(c, 0)["s"], F.element_at(c, -1)["e"]))
        return _let(near, lambda bs: F.filter(c, lambda x: ~F.exists(bs, meets(x["s"], x["e"]))))

    at = F.transform(F.sequence(F.lit(1), F.size(some), F.lit(BLOCK)), lambda i: _let(F.slice(some, i, BLOCK), block))
    return F.when((F.size(some) > 0) & (F.size(base) > 0), F.flatten(at)).otherwise(some)


def found_by_pattern(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: rid, doc_id, counts, the base spans, and what is seen of seeds and candidates."""
    out = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    text = F.col("__text")
    out = out.withColumns({f"__all_{k}": matches(text, PATTERNS[k], _NEEDS[k]) for k in KINDS})
    out = out.withColumn("__more", matches(text, CANDIDATE, "@|[0-9]"))
    out = out.withColumns({f"__{k}": F.filter(f"__all_{k}", _checked(k)) for k in KINDS})
    out = out.withColumn("base", _by_kind(lambda k: F.col(f"__{k}")))
    free = _apart(F.col("__more"), F.col("base"))
    seen = F.concat(*[F.transform(F.col(f"__{k}"), _sighting(i)) for i, k in enumerate(KINDS)], F.transform(free, _sighting(None)))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("rid", "doc_id", *counts, "base", F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), seen.alias("seen"))


def _bit(kind: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), kind)


def wilson(x: Column, n: Column) -> Column:
    """The lower bound of Wilson's interval of x out of n."""
    p = x / n
    return (p + Z2 / (2 * n) - F.sqrt(Z2 * (p * (1 - p) / n + Z2 / (4 * n * n)))) / (1 + Z2 / n)


def scored(seen: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(instance, kind, score) of instances, and the patterns (pattern, kind) that are sure, from sightings (kind, may, instance, patterns)."""
    edges = seen.select("instance", "kind", "may", F.explode("patterns").alias("p")).select(F.col("p.id").alias("pattern"), F.col("p.side").alias("side"), "instance", "kind", "may")
    pairs = scratch.write(edges.groupBy("pattern", "side", "instance").agg(F.bit_or("may").alias("may"), F.max("kind").alias("seed")), "pairs")
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("may").bitwiseAND(F.lit(1 << k)) > 0, 1)).alias(f"can_{k}") for k in range(len(ALL_KINDS))])
    sizes = scratch.write(sizes.where(F.col("n") >= LEAST), "sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    graph = common.hot_join(pairs, sizes.select("pattern"), ["pattern"], sizes.select("pattern", "n"), rows, F.col("instance"))
    graph = scratch.write(graph, "graph")
    scratch.drop("pairs")
    seeds = scratch.write(seen.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    can = F.get(F.array(*[F.col(f"can_{k}") for k in range(len(ALL_KINDS))]), F.col("kind"))
    open_ = scratch.write(graph.join(seeds.select("instance").distinct(), "instance", "left_anti").where("may > 0").select("pattern", "side", "instance", "may"), "open")
    known, sure = seeds, None
    for k in range(ROUNDS):
        mass = graph.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("x")).join(sizes, "pattern")
        n = F.col("x") + (F.col("n") - can) + 0.5 * F.greatest(can - F.col("x"), F.lit(0.0))
        sure = mass.withColumn("confidence", wilson(F.col("x"), n)).where(F.col("confidence") >= SURE).select("pattern", "kind", "confidence")
        sure = scratch.write(sure, f"sure-{k}")
        votes = open_.join(common.bounded(sure, sure.count()), "pattern").where(F.col("may").bitwiseAND(_bit(F.col("kind"))) > 0)
        best = [F.coalesce(F.max(F.when(F.col("side") == i, F.col("confidence"))), F.lit(0.0)).alias(f"c{i}") for i in range(3)]
        votes = votes.groupBy("instance", "kind").agg(*best).select("instance", "kind", F.greatest(F.col("c2"), F.when(F.col("c0") > 0, 1 - (1 - F.col("c0")) * (1 - F.col("c1"))).otherwise(0.0)).alias("score"))
        known = scratch.write(seeds.union(votes), f"known-{k}")
    return known, sure


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of every row of docs (doc_id, text).

    Counts are of base spans, n_added of those that the method adds, n_spans of all. spans lists the kinds in their order, secrets last. Null
    text counts as empty: no spans, the digest of "". Repeated rows give a row each, though an instance counts once in the graph. Added spans
    overlap neither base spans nor each other; of two kinds with equal scores the first is taken. No docs give no rows.
    Other columns of docs are not looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "private")
    rows = scratch.write(found_by_pattern(docs), "rows")
    seen = rows.select("rid", F.explode("seen").alias("x")).select("rid", "x.*")
    known, sure = scored(seen, scratch)
    good = known.where(F.col("score") >= ACCEPT)
    free = seen.where("not base and may > 0")
    most = good.groupBy("instance").agg(F.count("*").alias("good"))
    taken = free.select("rid", "instance", "may", "patterns", "s", "e").join(common.bounded(most, most.count()).select("instance"), "instance").join(good.withColumnRenamed("kind", "k"), "instance")
    taken = taken.where(F.col("may").bitwiseAND(_bit(F.col("k"))) > 0)
    here = taken.select("rid", "s", "k", F.explode("patterns").alias("p")).select("rid", "s", "k", F.col("p.id").alias("pattern")).join(common.bounded(sure, sure.count()).select("pattern", F.col("kind").alias("k")), ["pattern", "k"])
    here = here.select("rid", "s", "k").distinct().withColumn("here", F.lit(True))
    taken = taken.join(here, ["rid", "s", "k"], "left").where("here OR k IN (0, 2, 4)")  # e-mail addresses, cards and secrets are told by themselves
    taken = taken.groupBy("rid", "s", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("minus")))["minus"].alias("minus"))
    kind = F.get(F.array(*map(F.lit, ALL_KINDS)), -F.col("minus"))
    added = taken.groupBy("rid").agg(F.collect_list(F.struct(kind.alias("kind"), "s", "e")).alias("added"))
    none = F.expr("CAST(array() AS array<struct<kind:string,s:bigint,e:bigint>>)")
    out = rows.drop("seen").join(added, "rid", "left").withColumn("added", F.coalesce("added", none)).withColumn("both", F.concat("base", "added"))
    ordered = F.concat(*[F.array_sort(F.filter("both", _of_kind(k))) for k in ALL_KINDS])
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", _digest(ordered).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("both").cast("long").alias("n_spans"))


def op7_contextual_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
