"""Groups of near copies with DataFrame functions only: an exact Jaccard join by prefixes.

The shingles of a set are ordered from the rarest to the most frequent one. Sets of x and y
shingles that link have 4/9 of x + y in common at least, so behind the first common one each
still has that many: it stands among the first ninth of the smaller set and the first fifth
of the larger one. Only sets that share such a shingle at such places are compared.

Where very many sets share shingles, each is first compared with one of them only; the pairs
that are not connected by then are all compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.common import keep

SHINGLE = 5
#: So many pairs for each row of the shared shingles are compared at once.
PAIRS_A_ROW = 16
#: Turns in which a set is compared with one other under each of its shingles.
STAR_TURNS = 3
MOST_TURNS = 100


def _words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _shingles() -> Column:
    """The distinct shingles of ``words`` (all of them as one, if they are fewer)."""
    n = F.size("words")
    return F.array_sort(F.array_distinct(
        F.when(n >= SHINGLE, F.transform(
            F.sequence(F.lit(1), n - (SHINGLE - 1)),
            lambda i: F.xxhash64(F.slice("words", i, SHINGLE))))
        .when(n > 0, F.array(F.xxhash64("words")))))


def _prefixes(classes: DataFrame) -> DataFrame:
    """(token, rep, n, rest) of the shingles of a set at which it can meet another one.

    ``rest`` counts the shingle and those behind it. Shingles of one set only come first in
    the order and are not listed.
    """
    tokens = classes.select("rep", "n", F.explode("tokens").alias("token"))
    shared = (tokens.groupBy(F.col("token").alias("__token")).agg(F.count("*").alias("sets"))
              .where("sets > 1"))
    ranked = (tokens.join(shared, F.col("token") == F.col("__token"))
              .groupBy("rep", "n")
              .agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("shared"))
              .withColumn("lone", F.col("n") - F.size("shared")))
    places = F.floor(F.col("n") / 5).cast("int") + 1 - F.col("lone")
    return (ranked.where(places > 0)
            .select("rep", "n", "lone", F.posexplode(F.slice("shared", F.lit(1), places)))
            .select("col.token", "rep", "n", (F.col("n") - F.col("lone") - F.col("pos")).alias("rest")))


def _torn(prefixes: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows, with components, of the shingles whose sets are not in one component."""
    rows = prefixes.withColumn("c", F.col("rep"))
    if found is not None:
        rows = (prefixes.join(found, F.col("rep") == F.col("node"), "left")
                .withColumn("c", F.coalesce("component", "rep")).drop("node", "component"))
    several = (rows.groupBy(F.col("token").alias("__token"))
               .agg(F.min("c").alias("low"), F.max("c").alias("high"))
               .where("low <> high").select("__token"))
    return rows.join(several, F.col("token") == F.col("__token"), "left_semi")


def _pairs(torn: DataFrame, turn: int | None) -> DataFrame:
    """Pairs (a, b) that can link: of all sets under a shingle, or of one with all others."""
    small = torn.where(9 * F.col("rest") >= 8 * F.col("n"))
    if turn is not None:
        small = (small.groupBy("token").agg(F.min_by(
            F.struct("rep", "n", "rest", "c"), F.xxhash64(F.lit(turn), "rep")).alias("s"))
            .select("token", "s.*"))
    small = small.toDF(*(f"__{c}" for c in small.columns))
    either = (F.col("__n") < F.col("n")) | ((F.col("__n") == F.col("n"))
                                            & (F.col("__rep") < F.col("rep")))
    need = 4 * (F.col("__n") + F.col("n"))
    return (torn.join(small, F.col("token") == F.col("__token"))
            .where((F.col("c") != F.col("__c")) & (F.lit(turn is not None) | either)
                   & (9 * F.col("rest") >= need) & (9 * F.col("__rest") >= need))
            .select(F.least("rep", "__rep").alias("a"), F.greatest("rep", "__rep").alias("b"))
            .distinct())


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole sets have 80 of 100 shingles of their union in common."""
    left = classes.select(F.col("rep").alias("__a"), F.col("tokens").alias("x"))
    right = classes.select(F.col("rep").alias("__b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b"))
            .where(100 * common >= 80 * (F.size("x") + F.size("y") - common)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node can reach.

    By turns a node's larger neighbours, then its smaller ones, are linked to the least of
    them, until every node but the least of a component has one link, that to the least.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "page-links")
    for _ in range(MOST_TURNS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
        large = keep(both.where("v > u").join(low, F.col("u") == F.col("__u"))
                     .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(),
                     "page-links")
        low = large.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
        edges = keep(large.join(low, F.col("u") == F.col("__u")).where("v <> m")
                     .select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.toDF("u", "v")).distinct(), "page-links")
        ends = edges.agg(F.count("*"), F.count_distinct("u")).first()
        inner = edges.join(edges.select(F.col("v").alias("__v")), F.col("u") == F.col("__v"),
                           "left_semi")
        if ends[0] == ends[1] and not inner.limit(1).count():
            least = edges.select(F.col("v").alias("u"), "v").distinct()
            return edges.unionByName(least).toDF("node", "component")
    raise RuntimeError(f"components did not settle in {MOST_TURNS} turns")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) of every row, by the rules of ``set_join.link``; ids are unique.

    Words are lower-cased in A-Z and cut at ASCII white space; a set holds the distinct
    5-word shingles, or the whole word sequence of a shorter text; sets link when
    100 * common >= 80 * union. A text without words is alone.
    """
    # The words are written, so that their expression is not worked out for every shingle.
    words = keep(docs.select(F.col(id_col).cast("long").alias("id"), _words(
        F.col(text_col).cast("string")).alias("words")), "page-words")
    sets = keep(words.select("id", _shingles().alias("tokens"))
                .withColumn("rep", F.when(F.col("tokens").isNotNull(), F.xxhash64("tokens"))),
                "page-sets")
    classes = keep(sets.where("tokens is not null").groupBy("rep").agg(
        F.min("id").alias("doc"), F.first("tokens").alias("tokens"))
        .withColumn("n", F.size("tokens")), "page-classes")
    prefixes = keep(_prefixes(classes), "page-prefixes")
    tried = links = found = None
    for turn in [*range(STAR_TURNS), None]:
        torn = keep(_torn(prefixes, found), "page-torn")
        load = (torn.groupBy("token").agg(
            F.count("*").alias("all"), F.count_if(9 * F.col("rest") >= 8 * F.col("n")).alias("small"))
            .agg(F.sum("all"), F.sum(F.col("all") * F.col("small"))).first())
        if not load[0]:
            break
        every = turn is None or load[1] <= PAIRS_A_ROW * load[0]
        pairs = _pairs(torn, None if every else turn)
        if tried is not None:
            pairs = pairs.join(tried, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")),
                               "left_anti")
        pairs = keep(pairs, "page-pairs")
        more = keep(_similar(pairs, classes), "page-similar")
        if more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            found = keep(components(links), "page-components")
        if every:
            break
        once = pairs.toDF("__a", "__b")
        tried = once if tried is None else tried.unionByName(once)
    best = classes.select("rep", F.col("doc").alias("least"))
    if found is not None:
        whole = classes.join(found, F.col("rep") == F.col("node"), "left").select(
            "rep", "doc", F.coalesce("component", "rep").alias("c"))
        roots = whole.groupBy(F.col("c").alias("__c")).agg(F.min("doc").alias("least"))
        best = whole.join(roots, F.col("c") == F.col("__c")).select("rep", "least")
    best = best.withColumnRenamed("rep", "__rep")
    return sets.join(best, F.col("rep") == F.col("__rep"), "left").select(
        F.col("id").alias(id_col), F.coalesce("least", "id").alias("component_id"))
