"""Documents into shards of equal row counts, linked documents together, by balanced label propagation.

Every row starts in the shard of its position in a hashed order, so counts differ by one at most; a shard's start count
is its quota. In each round a neighbourhood without a shard asks for the one where most of its rows are, among those with
room for all of it; the shards take the largest first while room is left, whether rows there are linked or not. Who is
refused asks its next-best shard in the next round. Rounds end when no neighbourhood fits any more or after `rounds`. At
the end the rows of a neighbourhood go to its shard; all others stay where there is room left and fill the other places.
Only a neighbourhood larger than every room left is then apart.

Linked are the rows of one group (equal texts). A group larger than half a shard is cut by a hash of the ids into
cells of about half a shard, which are the neighbourhoods then: no shard could hold it whole.

DataFrame operations only. Cases: a null text counts as empty with a size of 16; null ids are rows like others;
repeated rows each get a slot; ties between shards are settled by a hash of cell and shard; fewer rows than shards
leave shards empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearcharge.llm.common import materialise, union_all

PART_ROWS = 20_000  # rows numbered together in one task


def numbered(df: DataFrame, within: list[str], order: list[str], parts: int, out: str) -> DataFrame:
    """Adds a gapless number from 0 inside each value of `within` (all rows together if none). Rows are numbered in
    hashed parts, the parts' sizes are added up; no task sees a whole group."""
    part = F.pmod(F.xxhash64(*order, *within), F.lit(parts)).alias("_part")
    placed = df.select("*", part)
    counts = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*within, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(starts) if parts <= 1_000 else starts, [*within, "_part"]).withColumn(out, (F.col("_start") + F.col("_row")).cast("bigint")).drop("_part", "_start", "_row")


def parts_for(rows: int, groups: int) -> int:
    return max(1, -(-rows // (groups * PART_ROWS)))


def document_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, size, text_crc32, same: the whole text's digest."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("id"), (F.octet_length(whole) + 16).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"), F.md5(whole).alias("same"))


def cells(rows: DataFrame, total: int, n_shards: int) -> DataFrame:
    """Adds cell: the neighbourhood of a linked row, null for others."""
    most = max(1, total // n_shards // 2)
    groups = materialise(rows.groupBy("same").agg(F.count("*").alias("_g")).filter("_g > 1"), "shard-groups")
    cut = F.ceil(F.col("_g") / F.lit(most))
    return rows.join(groups, "same", "left").withColumn("cell", F.when(F.col("_g").isNotNull(), F.xxhash64("same", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), cut)))).drop("_g")


def one_round(open_cells: DataFrame, votes: DataFrame, rooms: dict[int, int]) -> DataFrame:
    """cell, size, shard: cells that get a shard this round. Each asks the shard with room for it where most of its rows
    are, or one by hash if there is none; each shard takes the largest until its room is used."""
    with_room = sorted(((room, shard) for shard, room in rooms.items() if room > 0), reverse=True)
    places = F.array(*[F.struct(F.lit(room).cast("bigint").alias("room"), F.lit(shard).alias("shard")) for room, shard in with_room])
    fits = F.filter(places, lambda p: p["room"] >= F.col("size"))
    any_fit = F.get(fits, F.pmod(F.xxhash64("cell", F.lit(sum(rooms.values()))), F.size(fits)).cast("int"))["shard"]
    room_of = F.broadcast(votes.sparkSession.createDataFrame(with_room, "room bigint, shard int"))
    best = votes.join(open_cells, "cell").join(room_of, "shard").filter("room >= size").groupBy("cell").agg(F.max(F.struct("votes", F.xxhash64("cell", "shard").alias("h"), "shard")).alias("best"))
    asked = open_cells.filter(F.col("size") <= with_room[0][0]).join(best, "cell", "left")
    asked = asked.select("cell", "size", F.coalesce("best.votes", F.lit(0)).alias("votes"), F.coalesce("best.shard", any_fit).alias("shard"))
    used = F.sum("size").over(Window.partitionBy("shard").orderBy(F.desc("size"), F.desc("votes"), "cell").rowsBetween(Window.unboundedPreceding, 0))
    return asked.withColumn("_used", used).join(room_of, "shard").filter("_used <= room").select("cell", "size", "shard")


def propagate(docs: DataFrame, n_shards: int = 40, rounds: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, cell, shard: the placement, counts at most one apart. Rounds go on until no cell without a
    shard fits into one, or for `rounds`."""
    rows = materialise(document_rows(docs, key, text), "shard-rows")
    total = rows.count()
    state = cells(rows, total, n_shards)
    start = numbered(state, [], ["id", "text_crc32"], max(16, parts_for(total, 1)), "position")
    state = materialise(start.select("id", "size", "text_crc32", "cell", F.pmod("position", F.lit(n_shards)).cast("int").alias("shard")), "shard-start")
    quotas = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    rooms = dict(quotas)
    votes = materialise(state.filter("cell IS NOT NULL").groupBy("cell", "shard").agg(F.count("*").alias("votes")), "shard-votes")
    open_cells = materialise(votes.groupBy("cell").agg(F.sum("votes").alias("size")), "shard-cells")
    settled: list[DataFrame] = []
    while (rounds is None or len(settled) < rounds) and max(rooms.values()) > 0:
        got = materialise(one_round(open_cells, votes, rooms), "shard-round")
        taken = got.groupBy("shard").agg(F.sum("size").alias("n")).collect()  # a row for each shard
        if not taken:
            break
        settled.append(got)
        for r in taken:
            rooms[r["shard"]] -= r["n"]
        open_cells = materialise(open_cells.join(got.select("cell"), "cell", "left_anti"), "shard-cells")
    return moved(state, settled, rooms) if settled else state


def moved(state: DataFrame, settled: list[DataFrame], rooms: dict[int, int]) -> DataFrame:
    """Rows of settled cells in their cell's shard; the others stay while their shard has room and fill the rest."""
    keep = ["id", "size", "text_crc32", "cell"]
    to = materialise(union_all(settled).select(F.col("cell").alias("_cell"), F.col("shard").alias("_to")), "shard-settled")
    placed = materialise(state.join(to, F.col("cell") == F.col("_cell"), "left").select(*keep, "shard", "_to"), "shard-asked")
    together = placed.filter("_to IS NOT NULL").select(*keep, F.col("_to").alias("shard"))
    others = placed.filter("_to IS NULL").select(*keep, "shard")
    sizes = {r["shard"]: r["count"] for r in others.groupBy("shard").count().collect()}  # a row for each shard
    parts = max(8, parts_for(sum(sizes.values()), len(rooms)))
    room_of = F.broadcast(state.sparkSession.createDataFrame(sorted(rooms.items()), "shard int, room bigint"))
    others = materialise(numbered(others, ["shard"], ["id", "text_crc32"], parts, "_n").join(room_of, "shard"), "shard-others")
    stay = others.filter("_n < room").select(*keep, "shard")
    starts, at = [], 0
    for shard, room in sorted(rooms.items()):
        if room > sizes.get(shard, 0):
            starts.append((at, shard))
            at += room - sizes.get(shard, 0)
    if not at:
        return together.unionByName(stay)
    gone = numbered(others.filter("_n >= room").select(*keep), [], ["id", "text_crc32"], max(16, parts_for(at, 1)), "_n")
    places = F.array(*[F.struct(F.lit(a).cast("bigint").alias("at"), F.lit(s).alias("shard")) for a, s in starts])
    gone = gone.select(*keep, F.array_max(F.filter(places, lambda p: p["at"] <= F.col("_n")))["shard"].alias("shard"))
    return materialise(together.unionByName(stay).unionByName(gone), "shard-placed")


def sharded(docs: DataFrame, n_shards: int = 40, rounds: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard."""
    state = propagate(docs, n_shards, rounds, key, text)
    slotted = numbered(state, ["shard"], ["id", "text_crc32"], max(8, parts_for(state.count(), n_shards)), "slot")
    return slotted.select(F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(state: DataFrame) -> DataFrame:
    """linked (rows with neighbours), apart (rows outside the shard that holds most of their neighbours)."""
    votes = state.filter("cell IS NOT NULL").groupBy("cell", "shard").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return votes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("apart"))
