"""Merkle manifest of a table: a postorder log of each source's tree, proofs and their check (operator 11)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql
from .common import read, written
from .ranking import ranked

#: Children of a node, the fields of a leaf in order, hexadecimal digits of a digest.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64

#: Levels that one builder makes at a time, over an aligned block of FAN ** LEVELS nodes; bounds every group.
LEVELS = 2
BLOCK = FAN**LEVELS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = "key string, block long, n long, total long, digests array<string>"
PATH = "key string, block long, subroot string, left array<string>, right array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above the n nodes of one."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def completed(nodes: list[str], height: int) -> list[str]:
    """All nodes of the tree above `nodes`, `height` levels high, in the order in which they become complete."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        runs[level].append(node)
        if level < height and len(runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        add(level + 1, digest(*run))

    for node in nodes:
        add(0, node)
    for level in range(height):  # what stays open at the end has fewer children
        if runs[level]:
            close(level)
    return log


def position(level: int, index: int, n: int, height: int) -> int:
    """Place in the log of a tree of n leaves of its node `index` of `level`, from the sizes of the subtrees before it.

    When a node is complete, so are all nodes over the leaves up to its last
    one, on its own level and below, and all full runs before its first leaf above.
    """
    first, end = index * FAN**level, min(n, (index + 1) * FAN**level)
    return sum(-(-end // FAN**j) for j in range(level + 1)) + sum(first // FAN**j for j in range(level + 1, height + 1)) - 1


@functools.lru_cache(1024)
def positions(n: int, height: int) -> list[list[int]]:
    """`position` of all nodes, by level."""
    return [[position(level, i, n, height) for i in range(-(-n // FAN**level))] for level in range(height + 1)]


def siblings(log: list[str], n: int, height: int) -> tuple[list[list[str]], list[list[str]]]:
    """Of each node by level below the top: its run's others before and after it, joined, found by position."""
    left: list[list[str]] = []
    right: list[list[str]] = []
    for places in positions(n, height)[:height]:
        runs = ["".join(log[p] for p in places[i : i + FAN]) for i in range(0, len(places), FAN)]
        left.append([runs[i // FAN][: i % FAN * DIGEST] for i in range(len(places))])
        right.append([runs[i // FAN][(i % FAN + 1) * DIGEST :] for i in range(len(places))])
    return left, right


def leaf(text: Column) -> Column:
    """The leaf of a row, with `text` as its text: null fields are `-`, others have their length in bytes before them."""
    shown = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logs = [completed(d, height_of(n) if n <= BLOCK else LEVELS) for d, n in zip(batch.column("digests").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        columns = [pa.array(logs, pa.list_(pa.string())) if c == "digests" else batch.column(c) for c in batch.schema.names]
        yield pa.record_batch(columns, names=batch.schema.names)


def _rounds(nodes: DataFrame, most: int, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The log of each key's tree over `nodes(key, position, digest, n, total, *carried)`, as tables of blocks.

    A row holds an aligned block of BLOCK nodes of one level at most and all it makes on LEVELS levels above,
    in completion order; the last ones are the nodes of the next table.  `most` is the largest n.
    """
    rounds = []
    while True:
        block = F.floor(F.col("position") / BLOCK).cast("long").alias("block")
        items = F.sort_array(F.collect_list(F.struct("position", "digest", *carried))).alias("items")
        grouped = nodes.groupBy("key", block).agg(F.max("n").alias("n"), F.max("total").alias("total"), items)
        blocks = grouped.select("key", "block", "n", "total", *(F.col(f"items.{c}").alias(into) for c, into in (("digest", "digests"), *zip(carried, carried, strict=True))))
        rounds.append(written(blocks.mapInArrow(_segments, blocks.schema), "merkle"))
        if most <= BLOCK:
            return rounds
        most, carried = -(-most // BLOCK), ()
        nodes = rounds[-1].where(F.col("n") > BLOCK).select("key", F.col("block").alias("position"), F.element_at("digests", -1).alias("digest"), F.ceil(F.col("n") / BLOCK).alias("n"), "total")


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(key, digest) of each tree's top."""
    tops = [r.where(F.col("n") <= BLOCK).select("key", F.element_at("digests", -1).alias("digest")) for r in rounds]
    return functools.reduce(DataFrame.unionByName, tops)


def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path from each node that a block is made over, up to the root."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            n = row["n"]
            height = height_of(n) if n <= BLOCK else LEVELS
            count = min(BLOCK, n - row["block"] * BLOCK)
            left, right = siblings(row["digests"], count, height)
            for i in range(count):
                own = [(left[k][i // FAN**k], right[k][i // FAN**k]) for k in range(height)]
                out.append((row["key"], row["block"] * BLOCK + i, row["subroot"], [x for x, _ in own] + row["left"], [x for _, x in own] + row["right"]))
        types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["key", "block", "subroot", "left", "right"])


def _with_paths(rounds: list[DataFrame], start: DataFrame) -> DataFrame:
    """The first table of `rounds` with each block's path; `start` is that of each key's top."""
    above = None
    for table in reversed(rounds):
        held = table.where(F.col("n") <= BLOCK).join(start, "key")
        if above is not None:
            held = held.unionByName(table.where(F.col("n") > BLOCK).join(above, ["key", "block"]))
        above = held if table is rounds[0] else written(held.select("key", "block", "n", "digests", "subroot", "left", "right").mapInArrow(_downward, PATH), "paths")
    return above


@dataclass
class Manifest:
    """`root`; the blocks of all sources' trees and of the tree over their tops; `tops(name, position, digest)` of the sources."""

    root: str | None
    rounds: list[DataFrame]
    above: list[DataFrame]
    tops: DataFrame


def source_key(source: Column) -> Column:
    """A key that sorts as sources do, bytewise with null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def manifest(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of `docs(doc_id, source, lang, n_chars, text)`; `claimed` is what another party says a row's leaf is (null: the same).

    Leaves ascend by doc_id, null first, then by digest, so repeated rows and
    keys have a fixed order.  An empty table has root None.  Every group is an
    aligned block of BLOCK nodes, also within a source that holds most rows;
    only the number of a source's rows and the root come to the driver.
    """
    leaves = docs.select("doc_id", source_key(F.col("source")).alias("key"), leaf(F.col("text").cast("string")).alias("digest"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    placed = ranked(written(leaves, "leaves"), ["key"], [F.asc("doc_id"), F.asc("digest")])
    placed = written(placed, "placed")
    sizes = written(placed.groupBy("key").agg(F.count("*").alias("n")), "sizes").withColumn("total", F.col("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds = _rounds(placed.join(sizes, "key"), most, ("doc_id", "claimed"))
    tops = written(ranked(_tops(rounds).withColumnRenamed("key", "name"), [], [F.asc("name")]), "tops")
    n = tops.count()
    above = _rounds(tops.select(F.lit("").alias("key"), "position", "digest", F.lit(n).cast("long").alias("n"), F.lit(n).cast("long").alias("total")), n)
    root = _tops(above).first()
    return Manifest(root.digest if root else None, rounds, above, tops)


def proofs(of: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    folded_root is the root that follows from the claimed leaf, or else the leaf, and the original siblings.
    """
    start = of.tops.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right")).limit(1)
    top_paths = _with_paths(of.above, start).select("key", "block", "n", "digests", "subroot", "left", "right").mapInArrow(_downward, PATH)
    start = written(top_paths.join(of.tops, F.col("block") == F.col("position")).select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "left", "right"), "paths")
    blocks = _with_paths(of.rounds, start)
    kind = blocks.schema["doc_id"].dataType.elementType
    types = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str | None, str, str]] = []
            ids = pa.concat_arrays([batch.column("doc_id").flatten()])
            for row in batch.drop_columns(["doc_id"]).to_pylist():
                n = row["n"]
                height = height_of(n) if n <= BLOCK else LEVELS
                places = positions(len(row["claimed"]), height)
                left, right = siblings(row["digests"], len(row["claimed"]), height)
                upper = list(zip(row["left"], row["right"], strict=True))
                shared = "".join(a + b for a, b in upper)
                for i, other in enumerate(row["claimed"]):
                    path = [(left[k][i // FAN**k], right[k][i // FAN**k]) for k in range(height)]
                    own = node = row["digests"][places[0][i]]
                    node = own if other is None else other
                    for a, b in (*path, *upper):
                        node = digest(a, node, b)
                    found.append((own, row["subroot"], digest(*(a + b for a, b in path), shared), node))
            yield pa.record_batch([ids, *(pa.array([f[k] for f in found], pa.string()) for k in range(4))], names=types.names)

    out = blocks.select("doc_id", "claimed", "block", "n", "digests", "subroot", "left", "right").mapInArrow(run, types)
    root = F.lit(of.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def nodes(rounds: list[DataFrame]) -> DataFrame:
    """The log as a table: key, level, index, position (its place in the key's postorder log), digest; each node once."""

    def of(round_: int, table: DataFrame) -> DataFrame:
        base = round_ * LEVELS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    n, total, first = row["n"], row["total"], row["block"] * BLOCK
                    height = height_of(n) if n <= BLOCK else LEVELS
                    for level, places in enumerate(positions(min(BLOCK, n - first), height)):
                        for i, place in enumerate(places):
                            if level or not round_:
                                index = first // FAN**level + i
                                out.append((row["key"], base + level, index, position(base + level, index, total, height_of(total)), row["digests"][place]))
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["key", "level", "index", "position", "digest"])

        return table.select("key", "block", "n", "total", "digests").mapInArrow(run, "key string, level int, index long, position long, digest string")

    return functools.reduce(DataFrame.unionByName, (of(k, t) for k, t in enumerate(rounds)))


def proof(log: DataFrame, key: str, index: int, total: int) -> list[tuple[list[str], list[str]]]:
    """One leaf's siblings level by level, before and after it, read from `log` (see `nodes`) by their positions."""
    height = height_of(total)
    wanted: dict[int, tuple[int, bool]] = {}
    for level in range(height):
        own = index // FAN**level
        run = range(own // FAN * FAN, min(own // FAN * FAN + FAN, -(-total // FAN**level)))
        wanted |= {position(level, i, total, height): (level, i > own) for i in run if i != own}
    held = log.where((F.col("key") == key) & F.col("position").isin(list(wanted))).select("position", "digest").orderBy("position").collect()
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in range(height)]
    for r in held:
        level, after = wanted[r.position]
        out[level][after].append(r.digest)
    return out


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return proofs(manifest(docs, F.when(changed, leaf(F.translate("text", UPPER, LOWER)))))


def oracle_sql(levels: int = 6, top_levels: int = 3) -> str:
    """DuckDB SQL for op11's rows, with as many levels written out as sources of FAN ** levels rows need."""
    shown = {c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in FIELDS}

    def hashed(text: str) -> str:
        return f"sha256({' || '.join(text if c == 'text' else shown[c] for c in FIELDS)})"

    steps = [f"""
  base as (
    select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by key) as n
    from (select doc_id, coalesce('=' || source, '') as key, {hashed(shown["text"])} as leaf,
            case when {sql.crc32("doc_id::varchar")} % 5 = 0 then {hashed(shown["text"].replace("text::", sql.lowered("text") + "::"))} end as other
          from documents)),
  l0 as (select key, i, n, leaf as d from base)"""]

    def climb(name: str, height: int) -> None:
        for k in range(height):
            steps.append(f"""
  {name}{k + 1} as (select key, i // {FAN} as i, (n + {FAN - 1}) // {FAN} as n, sha256(string_agg(d, '' order by i)) as d from {name}{k} where n > 1 group by key, i // {FAN}, n),
  {name}s{k} as (
    select key, i, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as a,
      coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as b
    from {name}{k} where n > 1 window run as (partition by key, i // {FAN} order by i))""")
        steps.append(f"""
  {name}top as ({" union all ".join(f"select key, d from {name}{k} where n = 1" for k in range(height + 1))})""")

    climb("l", levels)
    steps.append("""
  t0 as (select '' as key, row_number() over (order by key) - 1 as i, count(*) over () as n, d, key as name from ltop)""")
    climb("t", top_levels)
    pairs = [f"ls{k}" for k in range(levels)] + [f"ts{k}" for k in range(top_levels)]
    joins = [f"left join ls{k} on ls{k}.key = base.key and ls{k}.i = base.i // {FAN**k}" for k in range(levels)]
    joins += ["join t0 on t0.name = base.key", *(f"left join ts{k} on ts{k}.i = t0.i // {FAN**k}" for k in range(top_levels))]
    sides = ", ".join(f"{p}.a as a{k}, {p}.b as b{k}" for k, p in enumerate(pairs))
    steps.append(f"""
  f0 as (select doc_id, leaf, t0.d as subroot, coalesce(other, leaf) as folded, {sides}
    from base {" ".join(joins)})""")
    for k in range(len(pairs)):
        steps.append(f"""
  f{k + 1} as (select * replace (case when a{k} is null then folded else sha256(a{k} || folded || b{k}) end as folded) from f{k})""")
    siblings_text = " || ".join(f"coalesce(a{k} || b{k}, '')" for k in range(len(pairs)))
    return f"""with {",".join(steps)}
select doc_id, leaf, subroot, (select d from ttop) as root, sha256({siblings_text}) as proof_sha256, folded as folded_root, folded = (select d from ttop) as verified
from f{len(pairs)}"""
