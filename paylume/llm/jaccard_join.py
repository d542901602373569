"""Size-aware heavy-light Jaccard join over word n-grams, and the components of its links.

Equal sets are one class; only the class's first document goes on. Light sets, of at most ``boundary`` shingles,
enumerate the subsets of each size that an admissible partner must share; equal subsets of the needed size are a
proof, so no check follows. Heavy sets go to inverted lists. A list's key is not a single shingle but all shingles of
the set in one range of hashes. Sizes are graded in steps of ``1 / limit ** 2``, and a set uses the ranges of its own
grade, and those of the grade below if a partner can be in it, so that linked sets always share a grade. ``n_ranges``
takes as many ranges as it takes for the chance that linked sets have no equal range with a shingle to stay under
``2 ** -SURE``, and no more: the wider a range, the less likely it is that long texts with a passage in common, which
are far from linked, share a list. Empty ranges get no list. Sets near the boundary do both. The boundary minimises the estimated rows of both parts, from the sizes of all sets.

Links from the lists are found in two rounds. First each set meets the member of its lists that has the most company,
the hub of a group of copies, which joins such a group without all its pairs. Then lists that still hold several
components are compared across components: pairs are made only where sizes and the parity sketches (one bit for each
range of hashes, flipped by each shingle; two sets differ in at least as many shingles as in bits) leave a link
possible. What is left is checked exactly, so no link between components is lost.

Null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle is one
shingle. Very long texts are handled whole. Ids are taken as unique. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import release, written
from .textkit import NOT_SPACE, Texts, mix, prefix_sums, range_hash, sub_batches

U64 = np.uint64
#: Largest set that may count as light.
MOST_LIGHT = 30
#: Bits of a set's parity sketch.
SKETCH = 1024
#: Linked sets have no list in common with a chance under ``2 ** -SURE``, about that of equal hashes.
SURE = 48
#: Parts over which the members of a class are dealt.
SALT = 16
#: Rows of a subset that one entry of a list costs.
LIST_COST = 2


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    starts, ends, of = texts.words(NOT_SPACE)
    value = texts.hashes(starts, ends, lower=True)
    sums = prefix_sums(value, 0)
    n_words = np.diff(of)
    many = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    doc = np.repeat(np.arange(len(many)), many)
    first = of[:-1][doc] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hashes = range_hash(sums, first, np.minimum(first + size, of[1:][doc]), 0)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(many) + 1))


def need(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of these sizes that are linked."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of ``n`` shares with a linked, different set, over all partner sizes."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({need(n, b, percent) for b in partners if need(n, b, percent) <= min(n, b)})


def n_subsets(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def grade(n, percent: int):
    """Size grade, in steps of ``1 / limit ** 2``: linked sets are of one grade or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (2 * np.log(100 / percent)) + 1e-9).astype(np.int64)


def lower_grade(n, percent: int):
    """Grade of the smallest set that can be linked with one of ``n``."""
    return grade(-(-percent * np.asarray(n) // 100), percent)


@functools.cache
def _ranges(g: int, percent: int) -> int:
    ends = [max((100 / percent) ** (2 * (g + end)), 1) for end in (0, 1)]
    pairs = [((100 - percent) / percent * x, 2 * percent * x / (100 + percent)) for x in ends]
    # more ranges than can differ, and so many that the common shingles all meet those with a chance under 2 ** -SURE
    most = math.ceil(max(max(differ + 1, differ * 2 ** min(SURE / common, 20)) for differ, common in pairs)) + 1

    def sure(n: int) -> bool:
        """A range is without a difference and has a common shingle with the chance ``equal``; that none of n is so has a
        chance of (1 - equal) ** n at most, as balls in boxes are negatively associated. Over the sizes of a grade, equal
        goes up, then down: the ends have the least."""
        for differ, common in pairs:
            equal = (1 - 1 / n) ** differ * (1 - (1 - 1 / n) ** common)
            if n * math.log2(1 - equal) > -SURE:
                return False
        return True

    return next((n for n in range(2, most) if sure(n)), most)


def n_ranges(g, percent: int) -> np.ndarray:
    """Ranges for pairs whose smaller set is of grade ``g``: the least number that gives linked pairs of all its sizes a list
    in common but with a chance under 2 ** -SURE."""
    of, where = np.unique(np.asarray(g, np.int64), return_inverse=True)
    return np.array([_ranges(x, percent) for x in of.tolist()], np.int64)[where].reshape(np.shape(g))


def list_entries(n: int, percent: int) -> int:
    grades = {int(grade(n, percent)), int(lower_grade(n, percent))}
    return sum(min(n, int(n_ranges(g, percent))) for g in grades)


def _list_rows(size: int, percent: int, above: int):
    """Keys of the inverted lists of each set of over ``above`` shingles: the content of its hash ranges, for each
    grade that a pair can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashes, of = shingle_sets(Texts(batch.column(1)), size)
            n = np.diff(of)
            own = np.repeat(np.arange(len(n)), n)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mine, low = grade(n, percent), lower_grade(n, percent)
            for g, keep in ((mine, n > above), (low, (n > above) & (low < mine))):
                good = keep[own]
                h, doc = hashes[good], own[good]
                if not len(h):
                    continue
                # shingles are sorted, so a range is a run of them
                place = ((h >> U64(32)) * n_ranges(g, percent)[doc].astype(U64)) >> U64(32)
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
                sums = np.add.reduceat(mix(h + U64(99)), first)
                keys = mix(sums ^ mix(place[first] * U64(4096) + g[doc[first]].astype(U64) + U64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[doc[first]])], names=["h", "id"])

    return run


def _node_rows(size: int):
    """Number of shingles and two fingerprints of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashes, of = shingle_sets(Texts(batch.column(1)), size)
            codes = []
            for salt in (3, 5):
                sums = np.zeros(len(hashes) + 1, U64)
                np.cumsum(mix(hashes * U64(salt)), out=sums[1:])
                codes.append(pa.array((sums[of[1:]] - sums[of[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(of)), *codes], names=["doc_id", "n", "fp1", "fp2"])

    return run


def _head_rows(size: int):
    """Parity sketch, the shingles of small sets, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashes, of = shingle_sets(Texts(batch.column(1)), size)
            n = np.diff(of)
            own = np.repeat(np.arange(len(n)), n)
            odd = np.bincount(own * SKETCH + (hashes % U64(SKETCH)).astype(np.int64), minlength=len(n) * SKETCH) % 2
            bits = np.packbits(odd.astype(bool)).view(np.int64)
            light = [hashes[a:b].view(np.int64) if b - a <= MOST_LIGHT else None for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(bits)), pa.array(light, pa.list_(pa.int64())), batch.column(1)],
                names=["id", "n", "bits", "small", "text"],
            )

    return run


def _subset_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, n, small in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes = mix(np.array(small, np.int64).view(U64))
                total = codes.sum(dtype=U64)
                for c in subset_sizes(n, percent):
                    gone = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
                    keys = mix((total - codes[gone].sum(axis=1, dtype=U64)) * U64(64) + U64(c))
                    for column, x in zip(out, (keys.view(np.int64).tolist(), [c] * len(keys), [n] * len(keys), [doc] * len(keys)), strict=True):
                        column += x
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["h", "c", "n", "id"])

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashes, of = shingle_sets(Texts(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "items"])

    return run


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest light size that makes the least rows, candidates of the lists included; ``sizes``: sets by size, up to
    MOST_LIGHT. Sets too small to have a linked, different set are light in any case."""
    free = next(n for n in range(1, 10_000) if n_subsets(n, percent) > 0) - 1

    def cost(b: int) -> float:
        rows = sum(m * n_subsets(n, percent) for n, m in sizes.items() if n <= b)
        return rows + sum(m * list_entries(n, percent) * LIST_COST for n, m in sizes.items() if n > b * percent // 100)

    return min(range(free, MOST_LIGHT + 1), key=cost)


def linked(percent: int, a: str, b: str, both: str) -> str:
    return f"100 * {both} >= {percent} * ({a} + {b} - {both})"


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document: ``n_shingles``, ``class_id`` (least id with the same set), ``component_id`` (least id reachable
    by links), and ``n_links`` (checked links of the class found on the way; enough to connect it)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = written(rows.mapInArrow(_node_rows(size), "doc_id long, n long, fp1 long, fp2 long"))
    same = nodes.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"))
    heads = rows.join(same.select(F.col("id").alias("doc_id")), "doc_id").select("doc_id", "text")
    heads = written(heads.mapInArrow(_head_rows(size), "id long, n long, bits array<long>, small array<long>, text string"))
    release(spark)
    by_size = {r[0]: r[1] for r in heads.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(by_size, percent)

    # light sets
    subsets = heads.where(F.col("n") <= boundary).select("id", "n", "small").mapInArrow(_subset_rows(percent), "h long, c int, n long, id long")
    least = subsets.groupBy("h", "c", "n").agg(F.min("id").alias("v"))
    light = subsets.join(least.withColumnRenamed("n", "m"), ["h", "c"]).where((F.col("id") != F.col("v")) & (F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("m"))))
    light = written(light.select(F.col("id").alias("u"), "v").distinct())
    del subsets, least
    release(spark)

    # heavy sets: lists of two or more sets; both sides of the join read one exchange
    posts = heads.where(F.col("n") > boundary * percent // 100).select("id", "text").mapInArrow(_list_rows(size, percent, boundary * percent // 100), "h long, id long").repartition("h")
    lists = posts.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("m")).where("first < last")
    busy = written(posts.join(lists.select("h", "m"), "h"))
    del posts, lists
    release(spark)
    company = busy.groupBy("id").agg(F.sum("m").alias("company"))
    entries = written(busy.drop("m").join(company.join(heads.select("id", "n"), "id"), "id"))
    del busy, company
    release(spark)
    hub = entries.groupBy("h").agg(F.max(F.struct("company", F.negative("id").alias("minus"), "n")).alias("hub"))
    first = entries.join(hub, "h").select("id", "n", F.negative("hub.minus").alias("v"), F.col("hub.n").alias("m"), F.col("hub.company").alias("company")).where("id <> v")
    first = first.where(F.least("n", "m") * 100 >= percent * F.greatest("n", "m")).groupBy("id").agg(F.max(F.struct("company", F.negative("v").alias("minus"))).alias("best"))
    first = first.select(F.col("id").alias("u"), F.negative("best.minus").alias("v"))
    apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))

    def possible(n: str, m: str):
        return apart * (100 + percent) <= (100 - percent) * (F.col(n) + F.col(m))

    def checked(pairs: DataFrame) -> DataFrame:
        """Linked ones of written pairs; the sets of these only are made again from their texts."""
        ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        sets = written(heads.select("id", "text").join(ids, "id", "left_semi").mapInArrow(_set_rows(size), "id long, items array<long>"))
        release(spark)
        with_u = pairs.join(sets.select(F.col("id").alias("u"), F.col("items").alias("a")), "u")
        with_both = with_u.join(sets.select(F.col("id").alias("v"), F.col("items").alias("b")), "v")
        return with_both.withColumn("both", F.size(F.array_intersect("a", "b"))).where(linked(percent, "size(a)", "size(b)", "both")).select("u", "v")

    own, others = heads.select(F.col("id").alias("u"), "n", "bits"), heads.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("bits_"))
    first = written(first.join(own, "u").join(others, "v").where(possible("n", "m")).select("u", "v"))
    release(spark)
    found = written(checked(first).unionByName(light))
    del first, hub, light
    release(spark)
    labels = components(found)
    # pairs across components of a list
    named = entries.join(labels, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    some = written(named.join(mixed, "h"))
    sketch = heads.join(some.select("id").distinct(), "id", "left_semi").select("id", "bits")
    some = some.join(sketch, "id")
    right = some.select("h", *(F.col(c).alias(f"{c}_") for c in ("id", "n", "component", "bits")))
    pairs = some.join(right, "h").where((F.col("component") < F.col("component_")) & (F.least("n", "n_") * 100 >= percent * F.greatest("n", "n_")) & possible("n", "n_"))
    pairs = written(pairs.select(F.col("id").alias("u"), F.col("id_").alias("v")).distinct())
    del right, some, sketch
    release(spark)
    more = checked(pairs)
    links = written(found.unionByName(more))
    del named, mixed, pairs, more
    release(spark)
    labels = components(links)
    degree = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("class_id")).agg(F.count("*").alias("n_links"))
    # members of one class are dealt over several tasks
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int")
    told = same.join(labels, "id", "left").join(degree.withColumnRenamed("class_id", "id"), "id", "left")
    parts = F.when(F.col("members") > 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(salt("id")))
    told = told.select("n", "fp1", "fp2", "id", "component", "n_links", F.explode(parts).alias("salt"))
    member = nodes.withColumn("salt", salt("doc_id")).join(told, ["n", "fp1", "fp2", "salt"], "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("class_id"), F.coalesce("component", "id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM d UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON r.to_id = b.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.to_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id
"""
