"""An exact similarity join of vectors with pruning by pivots: no pair at the threshold is lost, most others never meet.

Angles between vectors are a metric. Each direction has some pivots, vectors of its own; a vector is at home in the cell
of its nearest pivot. If x and y are at most theta apart and y is at home at pivot b, then by the triangle inequality

  angle(x, b) <= angle(x, home of x) + 2 theta     as y is nearer to b than to the home of x, and
  angle(x, b) <= radius of b + theta               the radius being the largest angle of a vector at home there.

So x visits only the cells that hold to both, and is compared with those at home there, as matrix products. Every pair
meets in one cell, that of y, and the exact cosine decides. On vectors without any clusters all cells may have to be
visited, as no bound of this kind tells them apart; then it is the join of all pairs in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.storage import stored

#: Vectors that a task of the join holds on either side, and the most pivots of a direction.
PART, PIVOTS = 4096, 256
#: Room for the rounding of angles, in radians.
SLACK = 1e-6
KEY = ["direction", "dim"]


def units(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _visits(theta: float):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"item_id": [], "home": [], "radius": [], "visits": []})
        pivots = pivots.sort_values("pivot")
        apart = angles(units(rows["vec"]), units(pivots["_vec"]))
        home = apart.argmin(axis=1)
        radius = apart[np.arange(len(rows)), home]
        cells = pivots["pivot"].to_numpy(dtype=np.int32)
        near = apart <= radius[:, None] + 2 * theta + SLACK
        asks = rows["asks"].to_numpy(dtype=bool)
        visits = [[{"cell": int(cells[j]), "angle": float(apart[i, j])} for j in np.flatnonzero(near[i])] if asks[i] else [] for i in range(len(rows))]
        return pd.DataFrame({"item_id": rows["item_id"], "home": cells[home], "radius": radius, "visits": visits})

    return run


def placed(rows: DataFrame, threshold: float, part: int = PART, pivots: int = PIVOTS) -> DataFrame:
    """rows (item_id, direction, vec, asks, ...) of usable vectors with ``home`` and the cells that each must visit.

    Pivots are the vectors of least hash in each of as many classes of ids, about two a part; they go along with chunks
    of bounded size, so no table of them is held whole.
    """
    theta = math.acos(threshold)
    rows = stored(rows.withColumn("dim", F.size("vec")), "join-vectors")
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
    sizes = stored(sizes.select(*KEY, F.least(F.lit(pivots), F.ceil(F.col("_n") * 2 / part) + 1).cast("long").alias("_pivots"), F.ceil(F.col("_n") / part).cast("long").alias("_chunks")), "join-sizes")
    dealt = rows.join(sizes, KEY).withColumn("_h", F.xxhash64("item_id", F.lit(5)))
    pivot_rows = stored(dealt.groupBy(*KEY, F.pmod("_h", F.col("_pivots")).cast("int").alias("pivot")).agg(F.min_by("vec", F.struct("_h", "item_id")).alias("_vec")), "join-pivots")
    chunks = dealt.select("item_id", *KEY, "vec", "asks", F.pmod(F.shiftright("_h", 20), F.col("_chunks")).cast("int").alias("_chunk"))
    copies = pivot_rows.join(sizes, KEY).select(*[F.col(c).alias(f"_{c}") for c in KEY], "pivot", "_vec", F.explode(F.sequence(F.lit(0), F.col("_chunks").cast("int") - 1)).alias("__chunk"))
    found = chunks.groupBy(*KEY, "_chunk").cogroup(copies.groupBy(*[f"_{c}" for c in KEY], "__chunk")).applyInPandas(_visits(theta), "item_id long, home int, radius double, visits array<struct<cell:int,angle:double>>")
    found = stored(rows.join(found, "item_id"), "join-homes")
    # a cell's radius counts those that can be found there; every direction has a row of at most ``pivots`` radii
    radii = stored(found.where("answers").groupBy(*KEY, "home").agg(F.max("radius").alias("r")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("home", "r"))).alias("_radii")), "join-radii")
    reach = lambda v: v["angle"] <= F.col("_radii")[v["cell"]] + theta + SLACK  # noqa: E731  null, where a cell is empty
    return found.join(radii, KEY).withColumn("visits", F.transform(F.filter("visits", reach), lambda v: v["cell"])).drop("_radii", "radius")


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero: others resemble nothing at a threshold
    above zero."""
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.where(F.col("item_id").isNotNull() & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False)))


def _tile(threshold: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (left["vec"], right["_vec"]))
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            ia, ib, in_batch = left["item_id"].to_numpy(dtype=np.int64), right["_item_id"].to_numpy(dtype=np.int64), right["_in_batch"].to_numpy(dtype=bool)
            for at in range(0, len(a), 512):
                cut = slice(at, at + 512)
                near = (a[cut] @ b.T / (na[cut, None] * nb[None, :]) >= threshold) & (ia[cut, None] != ib[None, :]) & (~in_batch[None, :] | (ib[None, :] < ia[cut, None]))
                first = np.where(near, ib[None, :], np.iinfo(np.int64).max).min(axis=1)
                hit = near.any(axis=1)
                out.append(pd.DataFrame({"item_id": ia[cut][hit], "origin": first[hit]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"item_id": [], "origin": []})

    return run


def tiles(rows: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visitors, members, sizes) of the cells: both sides dealt into parts, and (cell, visitors, members, parts of both).

    The sizes are stored, so that the joins with them are split where a cell is hot.
    """
    rows = stored(rows, "join-visits")
    cell = [*KEY, "cell"]
    visitors = rows.where("asks").select("item_id", *KEY, "vec", F.explode("visits").alias("cell"))
    members = rows.where("answers").select("item_id", *KEY, "vec", "in_batch", F.col("home").alias("cell"))
    count = lambda t, name: t.groupBy(*cell).agg(F.count("*").alias(name))
    parts = lambda name: F.ceil(F.col(name) / part).cast("int")
    sizes = stored(count(visitors, "visitors").join(count(members, "members"), cell).withColumn("na", parts("visitors")).withColumn("nb", parts("members")), "join-cells")
    place = lambda n: F.pmod(F.xxhash64("item_id"), F.col(n).cast("long")).cast("int")
    left = visitors.join(sizes, cell).withColumn("a", place("na")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("item_id", *cell, "vec", "a", "b")
    right = members.join(sizes, cell).withColumn("b", place("nb")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).select("item_id", *cell, "vec", "in_batch", "a", "b")
    return left, right, sizes


def least_similar(rows: DataFrame, threshold: float, part: int = PART, pivots: int = PIVOTS) -> DataFrame:
    """(item_id, duplicate_of): for each row that asks, the smallest id of those that answer in its direction with a
    cosine of at least ``threshold``, which is above 0. Of a row in the batch only smaller ids count.

    rows: (item_id, direction, vec, asks, answers, in_batch), one for each id.
    """
    if not 0 < threshold <= 1:
        raise ValueError("pivots bound cosines above 0 only")
    left, right, _ = tiles(placed(usable(rows), threshold, part, pivots), part)
    keys = [*KEY, "cell", "a", "b"]
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(_tile(threshold), "item_id long, origin long")
    return found.groupBy("item_id").agg(F.min("origin").alias("duplicate_of"))


def work(rows: DataFrame, threshold: float, part: int = PART, pivots: int = PIVOTS) -> DataFrame:
    """(direction, dim, compared, all_pairs): pairs of vectors that the join multiplies, and those without pruning."""
    good = usable(rows)
    _, _, sizes = tiles(placed(good, threshold, part, pivots), part)
    compared = sizes.groupBy(*KEY).agg(F.sum(F.col("visitors") * F.col("members")).alias("compared"))
    whole = good.groupBy("direction", F.size("vec").alias("dim")).agg((F.count_if("asks") * F.count_if("answers")).alias("all_pairs"))
    return whole.join(compared, KEY, "left").select(*KEY, F.coalesce("compared", F.lit(0)).alias("compared"), "all_pairs")
