"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set holds its distinct word shingles, as 64-bit hashes. Two sets
link when ``100 * intersection >= percent * union``. All sets are put in one
order, rare shingles first. With ``slack(n) = n - ceil(percent * n / 100)``,
two linked sets share at least ``l`` shingles among their first ``slack + l``
ones; if each takes an ``l`` of its own, at least the smaller ``l``. A set
whose prefix holds frequent shingles takes a longer prefix, so that fewer sets
reach the number they have to share with it.

Lists of sets by shingle are kept apart by size. Lists of few sets (``HOT`` at
most) make pairs directly. A frequent one
does not: all its sets are compared with one of them, the hub, and kept as
their difference from it. Sets linked to the hub are connected already; any
other link has a set outside, and by the triangle of differences its two sets
share part of what sets them apart from the hub, so these pairs come from an
index of the differences, by prefixes again: the set with fewer differences
by a prefix half as long as the other's, so that sets that each have changes
enough of their own do not meet in what sets the hub apart from all of them.
The work for a group of near copies so grows with its size and not with its
square, and no link is lost. This does not hold for sets close to the hub but
not linked to it: the lists of their differences have no bound like ``HOT``,
and sets that share a rare difference are compared in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.llm.common import Scratch, arrow_function, column, map_arrow, packed, pinned, ship, unpacked
from squall.llm.words import distinct, mix, pieces, shingles, slices, words

SIZE, PERCENT = 3, 90
#: Shingles in more prefixes than this go by hubs.
HOT = 8
#: Bound of the table of frequent shingles (12 bytes each), and shingles counted at a time.
TABLE, COUNTED = 600_000, 4_000_000
#: Numbers of shared shingles a prefix may ask for.
NEEDS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Estimated costs, in list entries: a comparison of two sets, and one more shingle in a prefix;
#: and the entries expected in the list of a shingle outside the table of frequent ones.
COMPARISON, LONGER, UNKNOWN = 20.0, 0.5, 0.1
#: Up to so many keys are looked up by broadcast (16 MB at most).
FEW_KEYS = 1_000_000
_LOST = np.uint64(0x94D049BB133111EB)       # marks a shingle of the hub that a set lacks


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin."""
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in pieces(texts):
        value, _, doc = shingles(words(texts.slice(begin, end - begin)), size)
        value, doc = distinct(value, doc)
        values.append(value)
        counts.append(np.bincount(doc, minlength=end - begin))
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def names_of(value: np.ndarray, at: np.ndarray) -> pa.Array:
    """16 bytes that name each set: two sums over its mixed hashes. Null for an empty set."""
    start = np.zeros(1, np.uint64)
    one = np.concatenate([start, np.cumsum(mix(value), dtype=np.uint64)])
    two = np.concatenate([start, np.cumsum(mix(value ^ _LOST), dtype=np.uint64)])
    both = np.stack([one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]]], axis=1)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())])
    return pa.compute.if_else(pa.array(at[1:] > at[:-1]), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))


def slack(n, percent: int):
    return n - -(-percent * n // 100)


def _described(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, n, name) of all documents, and rows (token, count) of shingles that several sets
    of a stretch hold, told apart by ``name`` and ``token`` being null."""
    def describe(batches):
        held, total = [], 0

        def counted():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count > 1
            n = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, keys.type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                 pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))],
                names=["key", "n", "name", "token", "count"])

        keys = None
        for batch in (part for whole in batches for part in slices(whole, "text")):
            keys = column(batch, "key")
            value, at = sets_of(column(batch, "text"), size)
            names = names_of(value, at)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(at).astype(np.int32)), names, pa.nulls(len(keys), pa.int64()),
                 pa.nulls(len(keys), pa.int64())], names=["key", "n", "name", "token", "count"])
            for i in _once(names):
                held.append(value[at[i]:at[i + 1]])
                total += len(held[-1])
            if total > COUNTED:
                yield counted()
                held, total = [], 0
        if held:
            yield counted()

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, describe, f"key {kind}, n int, name binary, token long, count long")


def _once(names: pa.Array) -> list[int]:
    """The first row of each name that is not null."""
    seen: dict[bytes, int] = {}
    for i, name in enumerate(names.to_pylist()):
        if name is not None:
            seen.setdefault(name, i)
    return list(seen.values())


def frequent_shingles(counts: DataFrame, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and in how many sets they were counted: all those above
    the least count that keeps the table within ``most``. The counts are approximate, as a shingle
    seen once in a stretch is not counted there: only the order of shingles and the lengths of
    prefixes rest on them, and any one order gives the same links."""
    sums = scratch.pin(counts.groupBy("token").agg(F.sum("count").alias("count")), "join-counts")
    levels = sums.groupBy(F.least("count", F.lit(100_000)).alias("count")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("count")).collect()         # 100,000 rows at most
    least, held = None, 0
    for r in levels:
        if held + r["n"] > most:
            break
        least, held = r["count"], held + r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = sums.where(F.col("count") >= least).toArrow()       # columns: rows as objects would be 300 MB
    token = table["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], table["count"].to_numpy().astype(np.int32)[order]


def prefix_of(often: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """For one set, given how often each of its shingles (sorted by hash) was counted: its order,
    how many shingles its prefix has, and how many it asks to share. The cost of a choice is the
    length of the prefix's lists, a comparison for each set that can be in as many of them as are
    asked for, and the prefix itself."""
    n = len(often)
    order = np.argsort(often, kind="stable")
    spare = slack(n, percent)
    length = np.cumsum(np.maximum(often[order] - 1.0, UNKNOWN))
    best = None
    for need in NEEDS:
        if need > n - spare:
            break
        entries = float(length[spare + need - 1])
        cost = entries + COMPARISON * entries / need + LONGER * need
        if best is None or cost < best[0]:
            best = (cost, need)
    return order, spare + best[1], best[1]


def _prefixes(rows: DataFrame, table: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """(token, name, n, need, at): the prefix of every set, ``at`` being a shingle's place in it.
    Equal sets of one batch appear once."""
    known, counts = table

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            value, at = sets_of(column(batch, "text"), size)
            names = names_of(value, at)
            often = np.zeros(len(value), np.int64)
            if len(known):
                place = np.searchsorted(known, value)
                place[place == len(known)] = 0
                often = np.where(known[place] == value, counts[place], 0)
            tokens, rows_, sizes, needs, places = [], [], [], [], []
            for i in _once(names):
                a, b = int(at[i]), int(at[i + 1])
                order, length, need = prefix_of(often[a:b], percent)
                tokens.append(value[a:b][order[:length]])
                rows_.append(np.full(length, i))
                sizes.append(np.full(length, b - a))
                needs.append(np.full(length, need))
                places.append(np.arange(length))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), names.take(pa.array(np.concatenate(rows_))),
                     *(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, needs, places))],
                    names=["token", "name", "n", "need", "at"])

    return map_arrow(rows, cut, "token long, name binary, n int, need int, at int")


def _lists(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The lists of prefix shingles, one for each shingle and band of sizes, with how ``often`` each
    is held; lists of one set are left out.

    Linked sets differ in size by at most 100 / percent, which is the width of a band: each set
    is in the lists of its ``own`` band and the next, and two linked sets meet in the larger of
    theirs. A set has to share as many shingles as it or a set it meets asks for; sets with
    fewer shingles in lists than that link with nothing and are left out, twice over."""
    own = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n")
    lists = rows.withColumn("own", own).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    for turn in range(3):
        held = lists.groupBy("token", "band").agg(F.count(F.lit(1)).alias("often"), F.min("need").alias("least")) \
            .where("often > 1")
        lists = scratch.pin(lists.join(held, ["token", "band"]), f"join-lists-{turn}")
        if turn < 2:
            enough = lists.groupBy("name").agg(F.countDistinct("token").alias("has"), F.min("least").alias("asked")) \
                .where("has >= asked").select("name")
            lists = lists.drop("often", "least").join(enough, "name", "left_semi")
    return lists.drop("least")


def _may_link(shared: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether two sets of sizes x and y that share so many shingles link."""
    return (100 + percent) * shared >= percent * (x + y)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Pairs (x, y) with ``n_x``, ``n_y``, ``linked`` and, if ``apart``, the difference of x from y:
    shingles only in x, and marked ones only in y."""
    a = sets.select(F.col("name").alias("x"), F.col("shingles").alias("of_x"))
    b = sets.select(F.col("name").alias("y"), F.col("shingles").alias("of_y"))

    def compare(batches):
        for batch in batches:
            sides = []
            for name in ("of_x", "of_y"):
                lists = column(batch, name)
                sides.append((np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)))
            (vx, ax), (vy, ay) = sides
            n_x, n_y, linked, differ = [], [], [], []
            for i in range(batch.num_rows):
                left, right = vx[ax[i]:ax[i + 1]], vy[ay[i]:ay[i + 1]]
                place = np.searchsorted(right, left)
                place[place == len(right)] = 0
                both = right[place] == left
                shared = int(both.sum())
                n_x.append(len(left))
                n_y.append(len(right))
                linked.append((100 + percent) * shared >= percent * (len(left) + len(right)))
                if apart:
                    rest = np.ones(len(right), bool)
                    rest[place[both]] = False
                    differ.append(np.concatenate([left[~both], mix(right[rest] ^ _LOST)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "x"), column(batch, "y"), pa.array(n_x, pa.int32()), pa.array(n_y, pa.int32()),
                 pa.array(linked, pa.bool_()), pa.array(differ if apart else [None] * len(linked), pa.list_(pa.int64()))],
                names=["x", "y", "n_x", "n_y", "linked", "apart"])

    return map_arrow(pairs.select("x", "y").join(a, "x").join(b, "y"), compare,
                     "x binary, y binary, n_x int, n_y int, linked boolean, apart array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, classes: DataFrame, documents: DataFrame, size: int,
          scratch: Scratch) -> DataFrame:
    """(name, shingles) of the wanted names, from the text of the class's smallest key; of a class
    without a key from any of its texts."""
    named = scratch.pin(wanted.join(classes, "name").select("key", "name"), "join-keys")
    keys = named.where("key is not null")
    n = keys.count()
    side = F.broadcast(keys) if n <= FEW_KEYS else keys

    def build(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            value, at = sets_of(column(batch, "text"), size)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
            own = names_of(value, at)
            made = pa.RecordBatch.from_arrays([own, lists], names=["name", "shingles"])
            if "name" in batch.schema.names:
                yield made.filter(pa.compute.equal(own, column(batch, "name")))     # rows can share a key, but not a text
            else:
                yield made.take(pa.array(_once(own), pa.int32()))

    schema = "name binary, shingles array<long>"
    built = map_arrow(rows.join(side, "key").select("name", "text"), build, schema)
    if documents.join(side, ["key", "name"]).count() > n:           # repeated rows
        built = built.dropDuplicates(["name"])
    keyless = named.where("key is null").select("name")
    n = keyless.count()
    if n:
        side = F.broadcast(keyless) if n <= FEW_KEYS else keyless
        more = map_arrow(rows.where("key is null").select("text"), build, schema)
        built = built.unionByName(more.join(side, "name", "left_semi").dropDuplicates(["name"]))
    return scratch.pin(built, "join-sets")


def _pairs_of_differences(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) of one hub, not both linked to it, that can link: from rows (hub, x, n_x, n_hub,
    linked, apart).

    Sizes N together allow ``k(N) = (100 - percent) * N / (100 + percent)`` shingles of difference.
    With d_x and d_y shingles of difference from the hub, a link needs ``(d_x + d_y - k) / 2``
    of them in common, which is at least ``d - (100 - percent) * n / percent`` for a set outside
    (sizes of linked sets differ by at most that share) and over ``d / 2`` less the sizes' part
    for one linked to the hub. Of two sets, the one with fewer differences (d_y) even has
    ``d_y - k / 2`` of them in common with the other, and k is at most the ``widest`` of either.
    Prefixes of the rarest differences are cut accordingly: the ``near`` half is looked up by sets
    with more differences."""
    outside = members.where("not linked").select("hub").distinct()
    some = members.join(outside, "hub").withColumn("d", F.size("apart"))
    widest = F.floor((100 - percent) * F.col("n_x") / percent)
    part = F.ceil((100 - percent) * F.greatest(F.col("n_x") - F.col("n_hub"), F.lit(0)) / (100 + percent))
    need = F.greatest(F.lit(1), F.when(F.col("linked"), F.floor((F.col("d") + 1 - part) / 2)), F.col("d") - widest)
    half = F.greatest(need, F.ceil(F.col("d") - (100 - percent) * F.col("n_x") / (2 * percent)))
    rows = some.select("hub", "x", "n_x", "d", "linked", (F.col("d") - need + 1).alias("prefix"),
                       (F.col("d") - half + 1).alias("near"), F.explode("apart").alias("token"))
    often = rows.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = rows.join(often, ["hub", "token"])
    own = Window.partitionBy("hub", "x")
    shared = shared.withColumn("place", F.col("d") - F.count(F.lit(1)).over(own)
                               + F.row_number().over(own.orderBy("often", "token"))).where("place <= prefix")
    shared = scratch.pin(shared.select("hub", "token", "x", "n_x", "d", "linked", (F.col("place") <= F.col("near")).alias("near")),
                         "join-differences")
    y = shared.where("near").select("hub", "token", F.col("x").alias("y"), F.col("n_x").alias("n_y"), F.col("d").alias("d_y"),
                      F.col("linked").alias("linked_y"))
    k = (100 - percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent)
    both = shared.where("not linked").join(y, ["hub", "token"]) \
        .unionByName(shared.where("linked").join(y.where("not linked_y"), ["hub", "token"]))
    return both.where(F.struct("d_y", "y") < F.struct("d", "x")) \
        .where(_may_link(F.least("n_x", "n_y"), F.col("n_x"), F.col("n_y"), percent)) \
        .where((F.col("d") + F.col("d_y") - k) / 2 <= F.least("d", "d_y")).select("x", "y").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, root) of every name in the links (x, y): the smallest name it is connected with.

    Large-star and small-star rounds: every name hands its larger (then its smaller) neighbours to
    the smallest one it knows, until nothing changes."""
    edges = scratch.pin(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v")
                   .distinct(), "join-edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each name's neighbours are now not larger than it
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = scratch.pin(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "join-edges")
        after = state(edges)
        if after == now:
            break
        now = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("name"), "root") \
        .unionByName(edges.select(F.col("v").alias("name"), F.col("v").alias("root")).distinct())


def _classes(df: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, name) of every row, and (name, component, top) of every set that is not alone: the
    smallest key of its component, and of the sets that have a row with this key the least name."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    described = scratch.pin(_described(rows, size), "join-described")
    documents = pinned(described.where("n is not null").select("key", "n", "name"), "join-documents")
    table = frequent_shingles(described.where("token is not null").select("token", "count"), TABLE, scratch)
    classes = scratch.pin(documents.where("name is not null").groupBy("name")
                          .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "join-classes")

    # one row of each set is cut into a prefix: the other copies are left out before if they are
    # few, and their equal prefixes merged if not, or if a copy shares its key with another set's
    # first row: rows are left out by key here, so all rows of such a key stay
    extra = scratch.pin(documents.join(classes.where("copies > 1").withColumnRenamed("key", "first"), "name")
                        .where("key != first").select("key").distinct(), "join-extra")
    few_extra = extra.count() <= FEW_KEYS
    once, several = rows, True
    if few_extra:
        first = classes.select("key").join(F.broadcast(extra), "key", "left_semi").distinct()
        extra = F.broadcast(scratch.pin(extra.join(first, "key", "left_anti"), "join-extra"))
        once = rows.join(extra, "key", "left_anti")
        several = documents.where("name is not null").join(extra, "key", "left_anti").count() > classes.count()
    prefixes = scratch.pin(_prefixes(once, table, size, percent), "join-prefixes")
    if several:
        prefixes = prefixes.groupBy("token", "name").agg(*(F.first(c).alias(c) for c in ("n", "need", "at")))
    often = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1").drop("often")
    lists = _lists(scratch.pin(prefixes.join(often, "token"), "join-lists"), percent, scratch)

    # few sets: pairs, with the number of shingles they share
    few = lists.where(F.col("often") <= HOT)
    other = few.select("token", "band", *(F.col(c).alias(f"{c}_y") for c in ("name", "n", "need", "at", "own")))
    behind = F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y"))
    pairs = few.join(other, ["token", "band"]).where(F.col("name") < F.col("name_y")) \
        .where(F.col("band") == F.greatest("own", "own_y")) \
        .where(_may_link(F.least("n", "n_y"), F.col("n"), F.col("n_y"), percent)) \
        .where(_may_link(F.least("at", "at_y") + behind, F.col("n"), F.col("n_y"), percent)) \
        .groupBy(F.col("name").alias("x"), F.col("name_y").alias("y"), F.least("need", "need_y").alias("need")) \
        .agg(F.count(F.lit(1)).alias("shared")).where("shared >= need").select("x", "y")
    pairs = scratch.pin(pairs, "join-pairs")

    # many sets: each with the list's hub, the set with most shingles in lists
    many = lists.where(F.col("often") > HOT)
    weight = lists.groupBy("name").agg(F.count(F.lit(1)).alias("weight"))
    hubs = many.join(weight, "name").groupBy("token", "band").agg(F.max(F.struct("weight", "name")).alias("top")) \
        .select("token", "band", F.col("top.name").alias("hub"))
    with_hub = scratch.pin(many.join(hubs, ["token", "band"]).where("name != hub").select(
        F.col("name").alias("x"), F.col("hub").alias("y")).distinct(), "join-hubs")
    both = pairs.unionByName(with_hub)
    wanted = both.select(F.col("x").alias("name")).unionByName(both.select(F.col("y").alias("name"))).distinct()
    sets = _sets(rows, wanted, classes.select("name", "key"), documents, size, scratch)
    direct = scratch.pin(_compared(pairs, sets, percent, False), "join-direct")
    members = scratch.pin(_compared(with_hub, sets, percent, True)
                          .select(F.col("y").alias("hub"), "x", "n_x", F.col("n_y").alias("n_hub"), "linked", "apart"),
                          "join-members")
    rest = scratch.pin(_compared(_pairs_of_differences(members, percent, scratch), sets, percent, False), "join-rest")
    links = direct.where("linked").select("x", "y") \
        .unionByName(members.where("linked").select("x", F.col("hub").alias("y"))) \
        .unionByName(rest.where("linked").select("x", "y"))
    roots = scratch.pin(components(links, scratch), "join-roots")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "name")).alias("least")
    smallest = roots.join(classes.select("name", "key"), "name").groupBy("root").agg(least)
    joined = roots.join(smallest, "root").select("name", F.col("least.key").alias("component"), F.col("least.name").alias("top"))
    copies = classes.where("copies > 1").join(roots, "name", "left_anti") \
        .select("name", F.col("key").alias("component"), F.col("name").alias("top"))
    found = pinned(joined.unionByName(copies), "join-components")
    scratch.drop()
    return documents, found


def join_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                    percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key reachable by links, its own
    included.

    Words are runs outside white space with A-Z lower-cased; fewer words than ``size`` make one
    shingle of the whole sequence. A null or empty text has an empty set, linked with nothing.
    Equal sets always link and are handled as one. Rows that share a key are each given by their
    own text. Rows with a null key link as all others do; their component is null unless another
    row of it has a key."""
    documents, found = _classes(df, key, text, size, percent)
    return documents.join(found, "name", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                     percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, with all their columns, of the smallest key of each component; of rows
    repeated with that key one stays. Rows that share a key are each judged by their own text, and
    so are rows without a key; of a component without any key one row stays. Rows without words
    stay."""
    documents, found = _classes(df, key, text, size, percent)

    def looked_up(some: DataFrame) -> DataFrame:
        return F.broadcast(some) if some.count() <= FEW_KEYS else some

    grouped = documents.join(found, "name")
    stays = F.col("key").eqNullSafe(F.col("component")) & (F.col("name") == F.col("top"))
    dropped = looked_up(pinned(grouped.where(~stays).select("key", "name").distinct(), "join-dropped"))
    # a key is judged by the texts of its rows if only some of them are dropped, or if one of
    # several equal ones stays, and else as a whole; rows without a key are judged by their texts
    some = documents.join(dropped, ["key", "name"], "left_anti").join(dropped, "key", "left_semi")
    several = grouped.where(stays).groupBy("key", "name").count().where("count > 1")
    by_text = pinned(some.select("key").unionByName(several.select("key")).where("key is not null").distinct(), "join-by-text")
    keyless = not grouped.where("key is null").isEmpty()
    whole = looked_up(pinned(dropped.select("key").where("key is not null").distinct().join(by_text, "key", "left_anti"),
                             "join-dropped-keys"))
    out = packed(df, own=F.col(key), text=F.col(text)).join(whole, F.col("own") == F.col("key"), "left_anti")
    if keyless or not by_text.isEmpty():
        def names(texts: pa.Array) -> pa.Array:
            return names_of(*sets_of(texts, size))

        out = out.join(looked_up(by_text), F.col("own") == F.col("key"), "left") \
            .withColumn("text", F.when(F.col("key").isNotNull() | F.col("own").isNull(), F.col("text"))).drop("key")
        out = out.withColumn("name", arrow_function(names, "binary")(F.col("text")))
        pairs = dropped.withColumnsRenamed({"key": "of", "name": "dropped"})
        judged = out.where("name is not null").join(
            pairs, F.col("own").eqNullSafe(F.col("of")) & (F.col("name") == F.col("dropped")), "left_anti")
        out = out.where("name is null").unionByName(judged.dropDuplicates(["own", "name"]))
    return unpacked(out)
