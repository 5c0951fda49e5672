"""Personal data: patterns, then information-theoretic sanitisation; DataFrame operations only.

Four patterns give the protected entities.  A term (a run of three letters or more) anywhere in a
document with an entity may give it away though it is not personal by itself.  Over all documents,

    PMI(t; e) = log2(n_te * N / (n_t * n_e)),    IC(e) = log2(N / n_e),

n counting documents, say how much of the information of e the term t carries; a term discloses e when
PMI >= share * IC.  Chance is kept out in two ways.  Where t met e in ``support`` different
surroundings (so that copies of one text prove nothing), PMI counts as it is.  Most entities have
fewer surroundings than that: there t must stand in all of them, and its frequency is smoothed,
(n_t + 1/2) / (N + 1/2), so that a term counts as rare only in a corpus large enough to tell.
Evidence is also pooled over generalised entities (local part, domain, number prefix), which need
``support`` surroundings: a term of many once-seen addresses of one domain discloses each of them.

Disclosing terms become spans of kind ``term`` wherever they stand in the document, outside entities;
``sanitise`` generalises entities to their kind and removes such terms.

Only documents with entities take part in shuffles, and of them only terms and places.  Terms too
frequent to disclose any entity, by the bound PMI <= log2(N / max(n_t, n_e)), are left out of the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .line_dedup import bound

KINDS = ("email", "ip", "card", "phone")
REACH, SUPPORT, SHARE = 60, 3, 0.9

# Possessive repeats and a start at the head of a run (or where the last match ended): the same
# matches as the plain patterns, in linear time and without recursion on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a search.
_HINT = {"email": "@", "ip": ".", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TERM = "\\p{L}{3,}+"
#: Pieces of a long text that cut no run of letters.
_PIECE = "(?s).{1,2000}\\p{L}*+"
#: Matches whose places are added up in one go, and code points of a part that surroundings are taken from:
#: both keep the work on a text in proportion to its length, and change no result.
BLOCK, PART = 256, 4096
#: Of the smoothed frequency of a term.
PSEUDO = 0.5


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the non-overlapping matches: code points, end exclusive.

    The parts between the matches and the matches themselves add up to the places.
    """

    def places(both: Column) -> Column:
        n = F.size(both["found"])

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(both["parts"], i))
            m = F.get(both["found"], i)
            e = s + F.length(m)
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m")))).alias("out"))

        def from_to(first: Column, to: Column, at: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))
            return F.aggregate(F.sequence(first, to - 1), start, step, lambda acc: acc["out"])

        def length(first: Column) -> Column:
            both_sides = F.concat(*(F.slice(both[c], first + 1, F.lit(BLOCK)) for c in ("parts", "found")))
            return F.aggregate(both_sides, F.lit(0), lambda acc, x: acc + F.length(x))

        def after(acc: Column, first: Column) -> Column:
            own = F.struct(first.alias("first"), acc["at"].alias("at"))
            return F.struct((acc["at"] + length(first)).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

        # appending copies the array, so a text of many matches goes block by block
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,at:int>>").alias("out"))
        blocks = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), start, after, lambda acc: acc["out"])
        many = F.flatten(F.transform(blocks, lambda x: from_to(x["first"], F.least(x["first"] + BLOCK, n), x["at"])))
        return F.when(n <= BLOCK, from_to(F.lit(0), n, F.lit(0))).otherwise(many)

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda f: F.when(F.size(f) == 0, none).otherwise(bound(F.struct(F.split(text, pattern, -1).alias("parts"), f.alias("found")), places)))


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        twice = F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int"))
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "", 19), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return bound(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """array<struct<kind, s, e, m>> of all passing matches, by kind as listed, then place."""
    none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")

    def of(kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind]), lambda x: _passes(kind, x["m"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
        likely = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike("[0-9][\\x20-]?[0-9]")
        return F.when(likely, spans).otherwise(none)

    return F.concat(*(of(k) for k in KINDS))


def _terms(text: Column) -> Column:
    """array<struct<s, e, m in lower case>> of all terms, piece by piece."""

    def of(piece: Column) -> Column:
        return F.transform(located(piece["m"], _TERM), lambda t: F.struct((t["s"] + piece["s"]).alias("s"), (t["e"] + piece["s"]).alias("e"), F.lower(t["m"]).alias("m")))

    return F.flatten(F.transform(located(text, _PIECE), of))


def _keys(x: Column) -> Column:
    """array<struct<exact, key>>: the entity, and what it has in common with its like."""
    kind, m = x["kind"], x["m"]
    key = lambda exact, *parts: F.struct(F.lit(exact).alias("exact"), F.concat(kind, F.lit(" "), *parts).alias("key"))
    wide = F.when(kind == "email", F.array(key(False, F.substring_index(m, "@", 1), F.lit("@")), key(False, F.lit("@"), F.lower(F.substring_index(m, "@", -1)))))
    wide = wide.when(kind == "ip", F.array(key(False, F.substring_index(m, ".", 3), F.lit("."))))
    wide = wide.otherwise(F.array(key(False, F.substring(_digits(m), 1, 6))))
    return F.concat(F.array(key(True, m)), wide)


def _occurrences(text: Column, found: Column, reach: int) -> Column:
    """array<struct<exact, key, place>>: the keys of the entities with a hash of the surroundings."""

    size = max(PART, reach)

    def every(parts: Column) -> Column:
        def cut(at: Column, n: Column) -> Column:
            """n code points from at on, at most ``reach`` of them: they lie in two parts."""
            k = F.floor(at / size).cast("int")
            both = F.concat(F.coalesce(F.get(parts, k), F.lit("")), F.coalesce(F.get(parts, k + 1), F.lit("")))
            return F.substring(both, at - k * size + 1, n)

        def around(x: Column) -> Column:
            lo = F.greatest(x["s"] - reach, F.lit(0))
            place = F.xxhash64(cut(lo, x["s"] - lo), cut(x["e"], F.lit(reach)))
            return F.transform(_keys(x), lambda k: F.struct(k["exact"].alias("exact"), k["key"].alias("key"), place.alias("place")))

        return F.flatten(F.transform(found, around))

    # a substring is sought from the start of its string: of a whole long text that is too far
    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), every)


def personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = REACH,
    support: int = SUPPORT,
    share: float = SHARE,
) -> DataFrame:
    """One row for each document: (doc_id, base, terms), arrays of spans (kind, s, e).

    ``base`` has the passing matches by kind as listed, then start; ``terms`` the disclosing terms by
    start, none inside a base span.  Null or empty text: no spans.  Repeated rows each give their row;
    further columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.select("doc_id", "text", entities(F.col("text")).alias("found"))
    some = F.size("found") > 0
    text = F.col("text")
    found = found.select(
        "doc_id",
        "found",
        F.when(some, F.xxhash64("text")).alias("row"),
        F.when(some, _occurrences(text, F.col("found"), reach)).alias("around"),
        F.when(some, _terms(text)).alias("words"),
    )
    found = scratch.put(found, "found")

    # a document counts once for a key, in one of its surroundings
    hit = found.where("row is not null")
    held = hit.select("doc_id", "row", F.explode("around").alias("a")).groupBy("doc_id", "row", "a.exact", "a.key").agg(F.min("a.place").alias("place"))
    held = scratch.put(held, "held")
    keys = held.groupBy("exact", "key", "place").agg(F.count("*").alias("n")).groupBy("exact", "key").agg(F.sum("n").alias("n_e"), F.count("*").alias("of_e"))
    keys = scratch.put(keys.where(F.col("exact") | (F.col("of_e") >= support)), "keys")
    n = texts.count() or 1
    bound_of = lambda n_e: F.lit(n ** (1 - share) * (1 + 1e-9)) * F.pow(n_e.cast("double"), F.lit(share))
    words = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower))).alias("term"))
    rare = words.groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= bound_of(F.lit(keys.agg(F.max("n_e")).first()[0] or 0)))
    rare = scratch.put(rare, "rare")
    terms = hit.select("doc_id", "row", F.explode(F.array_distinct(F.transform("words", lambda t: t["m"]))).alias("term")).distinct().join(rare, "term")
    # written first, since only plain exchanges are split where a key is hot
    held = scratch.put(held.join(keys, ["exact", "key"]), "known")
    pairs = scratch.put(held.join(terms, ["doc_id", "row"]).where(F.col("n_t") <= bound_of(F.col("n_e"))), "pairs")
    both = ["exact", "key", "term"]
    met = pairs.groupBy(*both, "place").agg(F.count("*").alias("n"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("of_e").alias("of_e"))
    met = met.groupBy(*both).agg(F.sum("n").alias("n_te"), F.count("*").alias("of_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("of_e").alias("of_e"))
    pmi = F.log2(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e")))
    smooth = F.log2(F.col("n_te") / F.col("n_e") * (n + PSEUDO) / (F.col("n_t") + PSEUDO))
    least = share * F.log2(F.lit(float(n)) / F.col("n_e"))
    often, always = F.col("of_te") >= support, F.col("exact") & (F.col("of_te") >= F.col("of_e"))
    disclosing = scratch.put(met.where((least > 0) & ((often & (pmi >= least)) | (always & (smooth >= least)))).select(*both), "disclosing")

    told = pairs.join(disclosing, both, "left_semi").groupBy("doc_id", "row").agg(F.collect_set("term").alias("told"))
    out = found.join(told, ["doc_id", "row"], "left")
    bare = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    said = F.filter("words", lambda t: F.array_contains("told", t["m"]) & ~F.exists("found", lambda b: (t["s"] < b["e"]) & (b["s"] < t["e"])))
    spans = F.transform(said, lambda t: F.struct(F.lit("term").alias("kind"), t["s"].alias("s"), t["e"].alias("e")))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    return out.select("doc_id", bare.alias("base"), F.when(F.col("told").isNull(), none).otherwise(spans).alias("terms"))


def sanitise(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col sanitised: an entity becomes its kind in brackets, a disclosing term goes.

    Where spans overlap, the earlier one (the longer one at the same start) wins.
    """
    cuts = F.array_sort(F.transform(F.concat("base", "terms"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    marks = spans.select(F.col("doc_id").alias(id_col), cuts.alias("__cuts")).where(F.size("__cuts") > 0)

    def step(acc: Column, x: Column) -> Column:
        put = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        piece = F.concat(F.substring(F.col(text_col), acc["at"] + 1, x["s"] - acc["at"]), put)
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("__cuts", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text_col), a["at"] + 1, F.length(text_col))))
    return docs.join(marks, id_col, "left").withColumn(text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(clean)).select(docs.columns)


def digests(result: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return result.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said("base").cast("binary"), 256).alias("base_sha256"),
        said(F.concat("base", "terms")).alias("spans"),
    )
