"""The prefix trie of conversations, from their sorted order.

Each turn becomes a 16-byte key, a conversation the keys of its turns in a row.
Sorted by these, distinct conversations have an array of longest common prefixes
(LCP, in turns); its Cartesian tree has one node for each branching of the trie:
a maximal run of conversations around equal LCPs, bounded by the nearest smaller
values on both sides. Equal LCPs merge into one node, and the depths between a
node and its parent are put back as a chain.

The array is cut into blocks, one per range of keys. A task walks its block with a
stack and settles all nodes that lie within. A node that crosses a border leaves a
fragment; its nearest smaller values lie in the nearest blocks with a smaller
minimum, among the few values that have no smaller one towards the border
(the block's stairs). Whatever a node counts is a difference of running sums at
its two ends, so no node gathers its members.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise, ship

NOTHING = hashlib.sha256(b"").hexdigest()
HIGHEST = (1 << 63) - 1

#: A node; ``row`` is its first row where it branches, ``parent_…`` the node above it where that has other members:
#: by its first row, or by a block and depth whose start lies in an earlier block.
NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, row long, parent_depth long, parent_row long, parent_block long"
#: Stairs: places of a block that a border's values can end at, with all sums up to them.
#: Those of side "all" stand for the end of a block.
STAIR = "side string, row long, lcp long, above_row long, above_block long, convs long, weight long, fresh long, fresh_after long, leaves long, low long, chars array<long>, ends_sha256 string"
TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FRAGMENT = "depth long, start_open boolean, stop_open boolean, elements long"


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell ``(role, text)`` apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def rebuilt(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, most: int = 6) -> DataFrame:
    """``(conv_id, key binary, chars array<long>)``: conversations that begin as the first of their group does.

    The first h turns of conversation c come from conversation c - c % group, the
    others are its own after the first h; h is the crc32 of c's decimals modulo
    ``most``. Turns are ordered by turn (null first), role and text's hash; null
    roles and texts are empty, rows without a conversation id belong to none. Only
    keys and sizes of turns are brought together, no texts.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.char_length(text).cast("long").alias("chars")).alias("t")
    )
    own = turns.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("c", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))
    own = materialise(own, "turns")
    h, base = F.crc32(F.col("c").cast("string").cast("binary")) % most, F.col("c") - F.pmod(F.col("c"), F.lit(group))
    named = own.select("c", base.alias("base"), h.cast("int").alias("h"), "turns")
    heads = named.where("c = base").select("base", F.slice("turns", 1, most).alias("head"))
    both = named.join(heads, "base", "left").select(
        "c", F.concat(F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")
    )
    return both.select(F.col("c").alias("conv_id"), F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "").alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")).withColumn("key", F.unhex("key"))


def id_digests(members: DataFrame, width: int = 4096) -> DataFrame:
    """``(key, conv_id)`` -> ``(key, n, least, ends_sha256)``: members, their smallest id, and the hash of all ids in order.

    Ids are put together by ranges of ``width`` of them first, so that a key of any
    number of members passes through its task as a few short texts, one after another.
    """
    ranges = members.groupBy("key", F.floor(F.col("conv_id") / width).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ranges = ranges.select("key", "range", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "least", "ends_sha256"])
        for batch in batches:
            for key, n, least, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        out.append((now, state[1], state[2], state[0].hexdigest()))
                    now, state = key, [hashlib.sha256(), 0, least]
                else:
                    text = "," + text
                state[0].update(text.encode())
                state[1] += n
                if len(out) >= 4096:
                    yield table(out)
                    out = []
        if state is not None:
            out.append((now, state[1], state[2], state[0].hexdigest()))
        if out:
            yield table(out)

    ordered = ranges.repartition("key").sortWithinPartitions("key", "range").select("key", "n", "least", "text")
    return ordered.mapInArrow(run, "key binary, n long, least long, ends_sha256 string")


def common_turns(a: bytes, b: bytes) -> int:
    """How many 16-byte keys two rows have in common at their beginning."""
    least = min(len(a), len(b)) // 16
    if not least:
        return 0
    differ = np.flatnonzero(np.frombuffer(a, "V16", least) != np.frombuffer(b, "V16", least))
    return int(differ[0]) if len(differ) else least


class Block:
    """One block of the sorted rows: its settled nodes, fragments and stairs.

    ``first`` is the number of its first row, ``lcp`` each row's LCP with the row
    before (-1 in the very first), ``after`` that of the first row beyond the block
    (-1 at the end of the table). The lists that the walk fills are ready for Arrow.
    """

    def __init__(self, block: int, first: int, lcp: list[int], after: int, convs, least, ends, chars):
        self.block, self.first, self.lcp, self.after = block, first, lcp, after
        self.ends, self.least = ends, least
        m = len(lcp)
        self.chars = [np.concatenate([[0], np.cumsum(np.asarray(c, dtype=np.int64))]) for c in chars]
        self.size = [len(c) - 1 for c in self.chars]
        total = np.array([int(c[-1]) for c in self.chars], dtype=np.int64)
        convs = np.asarray(convs, dtype=np.int64)
        follow = [*lcp[1:], after]
        fresh = total - np.array([int(c[max(v, 0)]) for c, v in zip(self.chars, lcp)], dtype=np.int64)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)]).tolist()  # noqa: E731  sums before each row
        self.convs, self.weight, self.fresh = sums(convs), sums(convs * total), sums(fresh)
        self.leaves = sums(np.array([s > v for s, v in zip(self.size, follow)], dtype=np.int64))
        self.total = total.tolist()
        low = np.asarray(least, dtype=np.int64)
        self.low_before = [HIGHEST, *np.minimum.accumulate(low).tolist()]
        self.low_after = np.minimum.accumulate(low[::-1])[::-1].tolist()
        self.nodes: list[tuple] = []
        self.fragments: list[tuple] = []
        self.stairs: list[tuple] = []
        self.m = m

    def walk(self) -> "Block":
        """Nearest smaller values by a stack of ``[depth, start, elements, least id]``; an open start is None."""
        stack: list[list] = []
        open_left = self.lcp[0] >= 0
        place = lambda e: (e[0], None, self.block) if e[1] is None else (e[0], self.first + e[1], None)
        above: list[tuple] = []  # of each row: the node of its own LCP
        for i in range(self.m + 1):
            v = self.lcp[i] if i < self.m else self.after
            if i == self.m and v >= 0:
                break  # the rest of the stack goes on in the next block
            start, low = i - 1, self.least[i - 1] if i else HIGHEST
            if i == 0:
                if open_left:
                    stack.append([v, None, 1, HIGHEST])
                    above.append(place(stack[-1]))
                else:
                    above.append((-1, None, None))
                continue
            self._leaf(i - 1, v, above[i - 1])
            while stack and stack[-1][0] > v:
                depth, start, elements, seen = stack.pop()
                low = min(low, seen)
                if start is None:
                    self.fragments.append((depth, True, i == self.m, elements))
                    continue
                parent = place(stack[-1]) if stack and stack[-1][0] >= v else (v, self.first + start, None)
                children = elements + 1 - (self.size[start] == depth)
                ends = self.ends[start] if self.size[start] == depth else NOTHING
                fresh = self.fresh[i] - self.fresh[start + 1] + self.total[start]
                sums = (self.convs[i] - self.convs[start], children, self.leaves[i] - self.leaves[start], self.weight[i] - self.weight[start], fresh)
                self.nodes.extend(chain(self.chars[start], low, depth, parent, *sums, ends, self.first + start))
            if stack and stack[-1][0] == v:
                stack[-1][2] += 1
                stack[-1][3] = min(stack[-1][3], low)
            elif v >= 0:
                stack.append([v, start, 1, low])
            if i < self.m:
                above.append(place(stack[-1]) if v >= 0 else (-1, None, None))
        if self.after >= 0:
            # the border's own element belongs to the next block, but the last row's chain ends here
            self._leaf(self.m - 1, self.after, above[-1], border=True)
            self.fragments.extend((depth, start is None, True, elements) for depth, start, elements, _ in stack)
        self._stairs(above)
        return self

    def _leaf(self, i: int, after: int, above: tuple, border: bool = False) -> None:
        """The chain of row ``i`` alone, below its neighbours' prefixes; none if it is one of them."""
        v, size = self.lcp[i], self.size[i]
        if size <= max(v, after):
            return
        parent = above if v >= after else (after, None, self.block + 1) if border else (after, self.first + i, None)
        n = self.convs[i + 1] - self.convs[i]
        self.nodes.extend(chain(self.chars[i], self.least[i], size, parent, n, 0, 1, n * self.total[i], self.total[i], self.ends[i], None))

    def _stairs(self, above: list[tuple]) -> None:
        def put(side: str, i: int, low: int) -> None:
            depth, row, block = above[i]
            chars = self.chars[i].tolist() if side == "start" else []
            self.stairs.append((side, self.first + i, self.lcp[i], row, block, self.convs[i], self.weight[i], self.fresh[i], self.fresh[i + 1], self.leaves[i], low, chars, self.ends[i]))

        least = HIGHEST
        for i in range(self.m - 1, -1, -1):  # where a border's value to the right may begin
            if self.lcp[i] < least:
                least = self.lcp[i]
                put("start", i, self.low_after[i])
        least = HIGHEST
        for i in range(self.m):  # the first row beyond a border's value to the left
            if self.lcp[i] < least:
                least = self.lcp[i]
                put("stop", i, self.low_before[i])
        m = self.m
        self.stairs.append(("all", self.first + m, min(self.lcp), None, None, self.convs[m], self.weight[m], self.fresh[m], self.fresh[m], self.leaves[m], self.low_before[m], [], NOTHING))


def chain(chars, low: int, depth: int, parent: tuple[int, int | None, int | None], n: int, children: int, leaves: int, weight: int, fresh: int, ends: str, row: int | None) -> Iterator[tuple]:
    """The nodes of depths ``parent + 1`` to ``depth``, all of the same members.

    ``weight`` sums the members' characters over conversations, ``fresh`` over the
    distinct nodes from the root on; what lies above a node is taken off both.
    """
    top = parent[0]
    for d in range(top + 1, depth + 1):
        past = int(chars[max(d - 1, 0)])
        saved = weight - n * past - (fresh - past)
        last = d == depth
        yield (low, d, n, children if last else 1, leaves, saved, ends if last else NOTHING, row if last else None, *(parent if d == top + 1 else (None, None, None)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _shape(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (p.strip().split(" ") for p in text.split(","))])


def sorted_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, list[int]]:
    """``(key, n, least, ends_sha256, chars)`` as written blocks with ``(block, pos, lcp)``, and their row counts.

    Blocks are ranges of the first 32 turns' keys; the LCP of a block's first row is not known yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, pos, before = TaskContext.get().partitionId(), 0, b""
        for batch in batches:
            keys = batch.column(0).to_pylist()
            lcp = [common_turns(a, b) for a, b in zip([before, *keys], keys)]
            before = keys[-1]
            places = np.arange(pos, pos + len(keys))
            columns = [pa.array(np.full(len(keys), block)), pa.array(places), pa.array(lcp, pa.int64()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "pos", "lcp", *batch.schema.names])
            pos += len(keys)

    count = max(1, -(-rows.count() // block_rows))
    dealt = rows.repartitionByRange(count, F.substring("key", 1, 512)).sortWithinPartitions("key")
    kept = materialise(dealt.select("key", "n", "least", "ends_sha256", "chars").mapInArrow(run, "block long, pos long, lcp long, key binary, n long, least long, ends_sha256 string, chars array<long>"), "blocks")
    sizes = {r["block"]: r["n"] for r in kept.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    return kept, [sizes.get(b, 0) for b in range(max(sizes, default=-1) + 1)]


def trie(rebuilt_rows: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """All nodes of the trie of ``(conv_id, key, chars)``, as ``rebuilt`` gives it.

    One row per distinct sequence of first turns: ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Conversations without a turn are
    members of the root, equal ones of the same nodes; no conversation gives no node.
    The driver holds a few numbers per block of ``block_rows`` distinct conversations.
    """
    spark = rebuilt_rows.sparkSession
    ship(spark)
    rows = materialise(rebuilt_rows, "rebuilt")
    ends = id_digests(rows.select("key", "conv_id"))
    distinct = rows.groupBy("key").agg(F.any_value("chars").alias("chars"))
    distinct = materialise(distinct.join(ends, "key"), "distinct")
    blocks, counts = sorted_blocks(distinct, block_rows)
    used = [b for b, n in enumerate(counts) if n]
    if not used:
        return spark.createDataFrame([], TRIE)
    number = {b: k for k, b in enumerate(used)}
    first = np.concatenate([[0], np.cumsum([counts[b] for b in used])]).astype(np.int64).tolist()

    # LCPs over the borders: the last key of each block beside the first of the next
    last_of = {b: counts[b] - 1 for b in used}
    ends_of = spark.createDataFrame([(b, last_of[b], number[b]) for b in used], "block long, last long, k long")
    edge = blocks.join(F.broadcast(ends_of), "block").where("pos = 0 OR pos = last")
    left = edge.where("pos = last").select((F.col("k") + 1).alias("k"), F.col("key").alias("a"))
    border = edge.where("pos = 0").select("k", F.col("key").alias("b")).join(left, "k")
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lcp = [common_turns(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lcp, pa.int64())], names=["k", "lcp"])

    found = {r["k"]: r["lcp"] for r in border.select("k", "a", "b").mapInArrow(over, "k long, lcp long").collect()}
    border_lcp = [found.get(k, -1) for k in range(len(used))] + [-1]

    walked = materialise(_walked(blocks, number, first, border_lcp), "walked")
    crossing, starts = _crossing(walked, len(used))
    return _parents(walked.where("kind = 'node'").select("node.*").union(crossing), starts)


def _walked(blocks: DataFrame, number: dict[int, int], first: list[int], border_lcp: list[int]) -> DataFrame:
    """``(kind, k, node, fragment, stair, low)`` of all blocks; a task may hold several, one after another."""
    shapes = {"node": _shape(NODE), "fragment": _shape(FRAGMENT), "stair": _shape(STAIR)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, k: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 20_000):
                some = rows[i : i + 20_000]
                columns = [pa.array([kind] * len(some)), pa.array([k] * len(some), pa.int64())]
                for name, shape in shapes.items():
                    kind_type = pa.struct(list(shape))
                    columns.append(pa.StructArray.from_arrays(_batch(some, shape).columns, fields=list(shape)) if name == kind else pa.nulls(len(some), kind_type))
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "k", *shapes])

        def settle(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, k = pa.Table.from_batches(held), number[block]
            lcp = rows["lcp"].to_pylist()
            lcp[0] = border_lcp[k]
            b = Block(k, first[k], lcp, border_lcp[k + 1], rows["n"].to_numpy(), rows["least"].to_numpy(), rows["ends_sha256"].to_pylist(), rows["chars"].to_pylist()).walk()
            yield from out("node", k, b.nodes)
            yield from out("fragment", k, b.fragments)
            yield from out("stair", k, b.stairs)

        now, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and int(ids[a]) != now:
                    yield from settle(now, held)
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(now, held)

    ordered = blocks.select("block", "pos", "lcp", "n", "least", "ends_sha256", "chars").repartition("block").sortWithinPartitions("block", "pos")
    return ordered.mapInArrow(run, f"kind string, k long, node struct<{_typed(NODE)}>, fragment struct<{_typed(FRAGMENT)}>, stair struct<{_typed(STAIR)}>")


def _typed(shape: str) -> str:
    return ",".join(":".join(p.strip().split(" ")) for p in shape.split(","))


class Minima:
    """Nearest block with a minimum below a value, and minima of runs of blocks, by doubling."""

    def __init__(self, values: list[int]):
        self.levels = [list(values)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            w, row = 1 << (len(self.levels) - 1), self.levels[-1]
            if len(row) <= w:
                break
            self.levels.append([min(a, b) for a, b in zip(row, row[w:])])

    def before(self, k: int, v: int) -> int | None:
        """The last block before ``k`` whose minimum is below ``v``."""
        for j in range(len(self.levels) - 1, -1, -1):
            while k - (1 << j) >= 0 and self.levels[j][k - (1 << j)] >= v:
                k -= 1 << j
        return k - 1 if k else None

    def beyond(self, k: int, v: int) -> int | None:
        """The first block after ``k`` whose minimum is below ``v``."""
        k, n = k + 1, len(self.levels[0])
        for j in range(len(self.levels) - 1, -1, -1):
            while k + (1 << j) <= n and self.levels[j][k] >= v:
                k += 1 << j
        return k if k < n else None

    def least(self, a: int, b: int) -> int:
        """The minimum of blocks ``a`` to ``b - 1``; the highest number of none."""
        if a >= b:
            return HIGHEST
        j = (b - a).bit_length() - 1
        return min(self.levels[j][a], self.levels[j][b - (1 << j)])



def _crossing(walked: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The nodes over borders, and ``(block, depth, row)`` of what starts before its block."""
    stairs = materialise(walked.where("kind = 'stair'").select("k", "stair.*"), "stairs")
    whole = {r["k"]: r for r in stairs.where("side = 'all'").select("k", "lcp", "low", "row", "convs", "weight", "fresh", "leaves").collect()}
    lcps, lows = Minima([whole[k]["lcp"] for k in range(blocks)]), Minima([whole[k]["low"] for k in range(blocks)])
    before = {n: np.concatenate([[0], np.cumsum([whole[k][n] for k in range(blocks)])]).tolist() for n in ("convs", "weight", "fresh", "leaves")}
    rows = whole[blocks - 1]["row"]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for k, depth, start_open, stop_open in zip(*(c.to_pylist() for c in batch.columns[:4])):
                left.append(lcps.before(k, depth) if start_open else k)
                beyond = lcps.beyond(k, depth) if stop_open else k
                right.append(blocks if beyond is None else beyond)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["k", "depth", "start_open", "elements", "left", "right"])

    fragments = walked.where("kind = 'fragment'").select("k", "fragment.depth", "fragment.start_open", "fragment.stop_open", "fragment.elements")
    fragments = fragments.mapInArrow(seek, "k long, depth long, start_open boolean, elements long, left long, right long")
    steps = lambda side: stairs.where(F.col("side") == side).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("row", "lcp"))).alias("steps"))
    lower = F.filter("steps", lambda s: s["lcp"] < F.col("depth"))
    fragments = fragments.join(steps("start").withColumnRenamed("k", "left"), "left").withColumn("row", F.element_at(lower, -1)["row"]).drop("steps")
    fragments = fragments.join(steps("stop").withColumnRenamed("k", "right"), "right", "left").withColumn("stop", F.coalesce(F.get(lower, F.lit(0))["row"], F.lit(rows))).drop("steps")
    fragments = materialise(fragments, "fragments")
    spans = fragments.groupBy("depth", "row").agg(F.sum("elements").alias("elements"), F.max("left").alias("left"), F.max("right").alias("right"), F.max("stop").alias("stop"))
    ends = [c for c in stairs.columns if c not in ("k", "side", "row")]
    start = stairs.where("side = 'start'").select("row", F.struct(*ends).alias("a"))
    stop = stairs.where("side = 'stop'").select(F.col("row").alias("stop"), F.struct(*(c for c in ends if c not in ("chars", "ends_sha256"))).alias("b"))
    shape = _shape(NODE)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, depth, left, right = r["a"], r["depth"], r["left"], r["right"]
                b = r["b"] or {"lcp": -1, "above_row": None, "above_block": None, "low": HIGHEST, "convs": 0, "weight": 0, "fresh": 0, "leaves": 0}
                span = {n: before[n][right] + b[n] - before[n][left] - a[n] for n in before}
                fresh = span["fresh"] - (a["fresh_after"] - a["fresh"]) + a["chars"][-1]
                low = min(a["low"], lows.least(left + 1, right), b["low"])
                up = a if a["lcp"] >= b["lcp"] else b
                ended = len(a["chars"]) - 1 == depth
                made = chain(a["chars"], low, depth, (up["lcp"], up["above_row"], up["above_block"]), span["convs"], r["elements"] + 1 - ended, span["leaves"], span["weight"], fresh, a["ends_sha256"] if ended else NOTHING, r["row"])
                while some := list(itertools.islice(made, 4096)):
                    yield _batch(some, shape)

    crossing = materialise(spans.join(start, "row").join(stop, "stop", "left").mapInArrow(settle, NODE), "crossing")
    return crossing, fragments.where("start_open").select(F.col("k").alias("block"), "depth", "row")


def _parents(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Each node's parent by its smallest member: above a chain's top that of the node found, within a chain the chain's own."""
    given = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    order = ["conv_id", "depth", "parent_conv_id", *given[2:]]
    branching = nodes.where("row IS NOT NULL").select("depth", "row", "conv_id")
    here = branching.select(F.col("depth").alias("parent_depth"), F.col("row").alias("parent_row"), F.lit(-1).cast("long").alias("parent_block"), F.col("conv_id").alias("parent_conv_id"))
    earlier = starts.join(branching, ["depth", "row"]).select(F.col("depth").alias("parent_depth"), F.lit(-1).cast("long").alias("parent_row"), F.col("block").alias("parent_block"), F.col("conv_id").alias("parent_conv_id"))
    tops = nodes.where("parent_depth >= 0").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("parent_row", "parent_block")})
    tops = tops.join(here.union(earlier), ["parent_depth", "parent_row", "parent_block"], "left").select(*order)
    roots = nodes.where("parent_depth < 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*order)
    inner = nodes.where("parent_depth IS NULL").withColumn("parent_conv_id", F.col("conv_id")).select(*order)
    return tops.union(roots).union(inner)
