"""Hard negatives by angular triangle filtering.

Each row stores its angles to a few reference directions. For an anchor and a window
of rows that lie together in angle order, the triangle inequality on the sphere
turns stored angles into an interval of cosines; times the norms it bounds every
score of the window. Only windows whose bounds, widened for rounding, overlap the
scores asked for are scored, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import exact_columns
from loomstat.operators.ranking import with_position
from loomstat.session import materialise

#: Reference directions, and the rows of the hash sample that they are chosen from.
REFERENCES, SAMPLE = 16, 1_024
#: Rows of a block, anchors of a group (one task holds one of each), rows of a window.
BLOCK_ROWS, GROUP_ROWS, WINDOW_ROWS = 8_192, 256, 64
_LONG = np.iinfo(np.int64)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an array of lists, padded with zeros to ``width``."""
    lengths = np.asarray(vectors.value_lengths())
    out = np.zeros((len(lengths), width), np.asarray(vectors.flatten()).dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(vectors.flatten())
    return out


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the rows divided by them (zero rows stay zero); large values are scaled first, so no square overflows."""
    rows = rows.astype(float)
    size = np.abs(rows).max(axis=1, initial=0)
    scaled = rows / np.where(size > 0, size, 1)[:, None]
    length = np.sqrt((scaled * scaled).sum(axis=1))
    return size * length, scaled / np.where(length > 0, length, 1)[:, None]


def reference_directions(rows: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Unit rows chosen farthest-first by angle, the longest row first; any directions give right bounds."""
    norms, units = _unit(rows)
    chosen = [units[int(norms.argmax())]]
    nearest = units @ chosen[0]
    while len(chosen) < min(n, len(rows)):
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ chosen[-1])
    return np.array(chosen)


def angle_margin(width: int) -> float:
    """How far a stored angle of a vector of that width may be off, by a safe factor: arccos turns an error e near 1 into sqrt(2 e)."""
    return 4 * float(np.sqrt(16 * np.finfo(float).eps * max(width, 1)))


def score_bounds(a_angles, a_norms, low, high, least, most, margin) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores between anchors and windows.

    An anchor has its angles and norm, a window the ``low`` and ``high`` of its rows'
    angles and their ``least`` and ``most`` norm. The angle between them is at least the gap
    and at most the sum of their angles to each reference.
    """
    gap, reach = np.zeros((len(a_angles), len(low))), np.full((len(a_angles), len(low)), np.pi)
    for r in range(a_angles.shape[1]):
        own = a_angles[:, r, None]
        np.maximum(gap, np.maximum(low[None, :, r] - own, own - high[None, :, r]), out=gap)
        np.minimum(reach, own + high[None, :, r], out=reach)
    top, bottom = np.cos(np.maximum(gap - margin, 0)), np.cos(np.minimum(reach + margin, np.pi))
    a = a_norms[:, None]
    upper = a * np.where(top > 0, most, least)[None, :] * top if top.ndim == 1 else a * np.where(top > 0, most[None, :], least[None, :]) * top
    lower = a * np.where(bottom > 0, least[None, :], most[None, :]) * bottom
    slack = 1 + 1e-9 * a * most[None, :]
    return lower - slack, upper + slack


def _asked(target: dict, low: int, high: int) -> tuple[int, float, float]:
    """The number of a target and the scores it asks for; without a positive score it asks for all from its floor on."""
    floor = -np.inf if target["floor"] is None else target["floor"]
    if target["score"] is None:
        return target["target"], floor, np.inf
    return target["target"], max(floor, -((-low * target["score"]) // 100)), (high * target["score"]) // 100


def search(anchors: dict, rows: dict, k: int, same: bool, low: int, high: int, window: int = WINDOW_ROWS) -> list[tuple[int, int, int, int]]:
    """(anchor, target, row id, score): for each target the k best rows of this block among those it asks for.

    ``rows`` come in angle order. ``same`` asks for rows of the anchor's label, else for all others.
    """
    a, x = anchors["v"], rows["v"]
    size = max(np.abs(a.astype(float)).max(initial=0), np.abs(x.astype(float)).max(initial=0))
    exact = size * size * max(a.shape[1], 1) < 2.0**53  # doubles then add whole numbers without rounding
    kind = float if exact else object
    a, x = a.astype(kind), x.astype(kind)
    targets = [[_asked(t, low, high) for t in found] for found in anchors["targets"]]
    targets = [[t for t in found if t[1] <= t[2]] for found in targets]
    need = np.array([min((float(t[1]) for t in found), default=np.inf) for found in targets])
    top = np.array([max((float(t[2]) for t in found), default=-np.inf) for found in targets])

    starts = np.arange(0, len(x), window)
    ends = np.minimum(starts + window, len(x))
    cut = lambda f, values: f.reduceat(values, starts, axis=0)
    lower, upper = score_bounds(
        anchors["angles"], anchors["norms"], cut(np.minimum, rows["angles"]), cut(np.maximum, rows["angles"]),
        cut(np.minimum, rows["norms"]), cut(np.maximum, rows["norms"]), angle_margin(a.shape[1]),
    )
    first, last = cut(np.minimum, rows["labels"]), cut(np.maximum, rows["labels"])
    own = anchors["labels"][:, None]
    wanted = (first <= own) & (own <= last) if same else ~((first == own) & (last == own))
    overlap = wanted & (upper >= need[:, None]) & (lower <= top[:, None])

    # Window by window, the anchors that overlap it are scored together.
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(a))]
    for w in np.flatnonzero(overlap.any(axis=0)):
        of, part = np.flatnonzero(overlap[:, w]), slice(starts[w], ends[w])
        scores = a[of] @ x[part].T
        fits = (scores >= need[of, None]) & (scores <= top[of, None]) & (rows["ids"][None, part] != anchors["ids"][of, None])
        alike = rows["labels"][None, part] == anchors["labels"][of, None]
        fits = fits.astype(bool) & (alike if same else ~alike)
        for i, k_ in zip(*np.nonzero(fits)) if not exact else ():
            found[of[i]].append((np.array([starts[w] + k_]), np.array([scores[i, k_]], object)))
        if exact:
            at, place = np.nonzero(fits)
            edges = np.searchsorted(at, np.arange(len(of) + 1))
            for i, n in enumerate(of):
                if edges[i] < edges[i + 1]:
                    places = place[edges[i] : edges[i + 1]]
                    found[n].append((starts[w] + places, scores[i, places]))
    out = []
    for n, parts in enumerate(found):
        if not parts:
            continue
        places, scores = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        for target, least, most in targets[n]:
            fits = np.flatnonzero(((scores >= least) & (scores <= most)).astype(bool))
            if exact and len(fits) > 4 * k:
                floor = np.partition(scores[fits], -k)[-k]
                fits = fits[scores[fits] >= floor]
            best = sorted(fits.tolist(), key=lambda f: (-scores[f], rows["ids"][places[f]]))[:k]
            out += [(int(anchors["at"][n]), target, int(rows["ids"][places[f]]), min(max(int(scores[f]), _LONG.min), _LONG.max)) for f in best]
    return out


_FOUND = "at long, target int, vec_id long, score long"


def _side(table: pa.Table, width: int) -> dict:
    column = lambda name: table.column(name).combine_chunks()
    out = {"v": _matrix(column("v"), width), "ids": column("id").to_numpy(), "labels": column("label").to_numpy(), "norms": column("norm").to_numpy()}
    return out | {"angles": _matrix(column("angles"), max(np.asarray(column("angles").value_lengths())))}


def _searched(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The rows that ``search`` finds over all pairs (group, block)."""
    left = anchors.join(pairs, "group")
    right = rows.join(pairs.select(F.col("group").alias("of"), "block"), "block")
    right = right.select(F.col("of").alias("g"), F.col("block").alias("b"), *[F.col(c).alias(c) for c in ("id", "label", "v", "norm", "angles", "at")])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(held):
            held = held.sort_by("at")
            own = _side(asked, width) | {"at": asked.column("at").to_numpy(), "targets": asked.column("targets").to_pylist()}
            found = search(own, _side(held, width), k, same, low, high)
        columns = list(zip(*found)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("at", "target", "vec_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

    return left.groupBy("group", "block").cogroup(right.groupBy("g", "b")).applyInArrow(run, _FOUND)


def _extent(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Per key the extent of labels, norms and angles."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("label", "norm") for name, f in (("min", F.min), ("max", F.max))]
    angles = [F.array(*[f(F.col("angles")[r]) for r in range(n)]).alias(f"{name}_angles") for name, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(key).agg(*ends, *angles)


def _bounds(n: int, margin: float) -> tuple[Column, Column]:
    """Bounds of the scores between a group (g) and a block (b) from their extents."""
    a, b = (lambda name, r: F.col(f"g.{name}_angles")[r]), (lambda name, r: F.col(f"b.{name}_angles")[r])
    gap = F.greatest(F.lit(0.0), F.lit(0.0), *[F.greatest(b("min", r) - a("max", r), a("min", r) - b("max", r)) for r in range(n)])
    reach = F.least(F.lit(float(np.pi)), F.lit(float(np.pi)), *[a("max", r) + b("max", r) for r in range(n)])
    most, least = (F.col(f"g.{name}_norm") * F.col(f"b.{name}_norm") for name in ("max", "min"))
    top, bottom = F.cos(F.greatest(gap - margin, F.lit(0.0))), F.cos(F.least(reach + margin, F.lit(float(np.pi))))
    slack = 1 + most * 1e-9
    return F.when(bottom > 0, least).otherwise(most) * bottom - slack, F.when(top > 0, most).otherwise(least) * top + slack


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at", "target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    asked: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product with an anchor, a row
    where ``asked`` holds (a condition on ``id_col``). The positives of an anchor are its best rows of the same
    label; for each positive the best rows of other labels are returned whose
    score is at least ``low`` and at most ``high`` percent of the positive's. Higher
    scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Rows with the anchor's id are not its candidates; rows that share another id
    are each one. Every row of a repeated anchor id is an anchor. Vectors of different length are padded with zeros;
    components and scores beyond 64 bits are cut to them. Labels are whole numbers. Other columns
    are ignored; a table without anchors or rows gives no rows.

    Scale: rows lie in one global order of label, nearest reference and angle, cut into
    blocks; anchors likewise into groups. A group first searches the blocks it lies in,
    which gives each anchor a floor, then only blocks whose bounds reach the least floor;
    negatives likewise, starting from one distant block. A task holds one group and
    one block, whatever the number of rows of a label.
    """
    rows = exact_columns(vectors, id_col, label_col, vector_col).toDF("id", "label", "x")
    spark, bad = vectors.sparkSession, F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    numbers = F.transform("x", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), numbers.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return spark.createDataFrame([], schema)

    # A sample of bounded size: the rows of the smallest hashes.
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    directions = reference_directions(_matrix(sample, width))
    n, margin = len(directions), angle_margin(width)

    def with_angles(batches):
        for batch in batches:
            norms, units = _unit(_matrix(batch.column(2), width))
            angles = np.arccos(np.clip(units @ directions.T, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, angles.size + 1, n, dtype=np.int32)), pa.array(angles.ravel()))
            nearest = angles.argmin(axis=1).astype(np.int32) if len(angles) else np.zeros(0, np.int32)
            extra = [pa.array(norms), lists, pa.array(nearest), pa.array(angles.min(axis=1, initial=np.pi))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["id", "label", "v", "norm", "angles", "cell", "angle"])

    stored = rows.mapInArrow(with_angles, "id long, label long, v array<long>, norm double, angles array<double>, cell int, angle double")
    order = [F.col(c) for c in ("label", "cell", "angle", "id")]
    placed = materialise(with_position(stored, order, "at"), "angles")
    placed = placed.withColumn("block", F.floor(F.col("at") / F.lit(BLOCK_ROWS)))
    anchors = placed.withColumn(id_col, F.col("id")).where(asked).select("id", "label", "v", "norm", "angles", "cell", "angle", "at", "block")
    anchors = with_position(anchors.withColumnRenamed("block", "home"), [F.col("at")], "number")
    anchors = materialise(anchors.withColumn("group", F.floor(F.col("number") / F.lit(GROUP_ROWS))).drop("number", "cell", "angle"), "anchors")

    blocks = materialise(_extent(placed, "block", n), "block-extents").alias("b")
    groups = materialise(_extent(anchors, "group", n), "group-extents").alias("g")
    lower, upper = _bounds(n, margin)
    target = "array<struct<target:int,score:long,floor:long>>"

    def all_of(floors: DataFrame | None) -> DataFrame:
        """Anchors with one target, all scores from the floor on."""
        if floors is None:
            return anchors.withColumn("targets", F.expr(f"cast(array(struct(0, null, null)) as {target})"))
        one = anchors.join(floors.select("at", F.col("score").alias("floor")), "at", "left")
        return one.withColumn("targets", F.expr(f"cast(array(struct(0, null, floor)) as {target})")).drop("floor")

    # Positives: the blocks a group lies in, then all others that hold one of its labels and may reach a floor.
    near = materialise(anchors.select("group", F.col("home").alias("block")).distinct(), "pairs")
    found = materialise(_searched(all_of(None), placed, near, width, positives, True), "found")
    floors = _best(found, positives).where(F.col("rank") == positives)
    least = anchors.join(floors.select("at", "score"), "at", "left").groupBy("group")
    least = least.agg(F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("need"))
    labels = anchors.select("group", "label").distinct().join(placed.select("block", "label").distinct(), "label").select("group", "block").distinct()
    rest = labels.join(near, ["group", "block"], "left_anti").join(least, "group")
    rest = rest.join(groups, "group").join(blocks, "block").where(upper >= F.col("need")).select("group", "block")
    rest = materialise(rest, "pairs")
    found = found.unionByName(_searched(all_of(floors), placed, rest, width, positives, True))
    chosen = materialise(_best(found, positives).select("at", F.col("rank").alias("target"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: one block half the table away gives floors, then all others whose bounds overlap the scores asked for.
    def wanting(floors: DataFrame | None) -> DataFrame:
        own = chosen if floors is None else chosen.join(floors.select("at", "target", F.col("score").alias("floor")), ["at", "target"], "left")
        floor = F.lit(None).cast("long") if floors is None else F.col("floor")
        own = own.groupBy("at").agg(F.collect_list(F.struct("target", F.col("positive_score").alias("score"), floor.alias("floor"))).alias("targets"))
        return anchors.join(own, "at")

    n_blocks = placed.agg(F.max("block") + 1).first()[0]
    far = anchors.groupBy("group").agg(F.min("home").alias("home"))
    far = materialise(far.select("group", ((F.col("home") + n_blocks // 2) % n_blocks).alias("block")), "pairs")
    seen = materialise(_searched(wanting(None), placed, far, width, negatives, False, low, high), "found")
    floors = _best(seen, negatives).where(F.col("rank") == negatives)
    asked_for = chosen.join(floors.select("at", "target", "score"), ["at", "target"], "left").join(anchors.select("at", "group"), "at")
    s = F.col("positive_score").cast("double")
    window = asked_for.groupBy("group").agg(
        F.min(F.greatest(s * (low / 100) - 1 - F.abs(s) * 1e-9, F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))).alias("need"),
        F.max(s * (high / 100) + 1 + F.abs(s) * 1e-9).alias("most"),
    )
    every = groups.join(window, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    only = (F.col("g.min_label") == F.col("g.max_label")) & (F.col("b.min_label") == F.col("b.max_label")) & (F.col("g.min_label") == F.col("b.min_label"))
    every = every.alias("g").join(blocks, "block").where((upper >= F.col("need")) & (lower <= F.col("most")) & ~only)
    every = materialise(every.select("group", "block").join(far, ["group", "block"], "left_anti"), "pairs")
    seen = seen.unionByName(_searched(wanting(floors), placed, every, width, negatives, False, low, high))
    best = _best(seen, negatives).join(chosen, ["at", "target"]).join(anchors.select("at", "id"), "at")
    return best.select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
