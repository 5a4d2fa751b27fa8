"""Queries p1, p2, p4, p5 and p6 over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.operators.cdc import SEQ, EqualityDeleteTable, committed_mutations, last_checkpoints, touched_and_present
from quiver.operators.incremental import ChangeState, below_floor, in_ranges
from quiver.operators.log import placed_records
from quiver.operators.selection import select_rank
from quiver.operators.snapshots import as_set, consecutive, snapshot_changes
from quiver.sources.csv_quarantine import parse_lines, typed_columns
from quiver.workdir import materialise, scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class _Failed(RuntimeError):
    """A run of the consumer that didn't succeed, played through again."""


def _fail(rows: DataFrame) -> None:
    raise _Failed


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Log records that no successful run has taken in.

    The consumer's history goes through the operator: its loads of snapshots
    are a run, so are its reads of ranges of the log, and between them the
    reads that failed, whose work raises and which must leave no trace.  Each
    run gets only records that the versions before it lack, and the next run's
    records are those that the last published version lacks.
    """
    content = ["segment_id", "byte_offset", "record_kind", "event_kind", "entity_kind", "entity_id", "payload"]
    state = ChangeState(spark, scratch_path(spark, "p1-state"), ["shard_id", "lsn"], content)
    runs, snapshots = table(spark, sf, "sync_run"), table(spark, sf, "snapshot_info")
    placed = placed_records(table(spark, sf, "wal_record"), table(spark, sf, "wal_segment"), *content, "landed_at")
    current = materialise(state.keyed(state.hashed(placed), F.min("landed_at").alias("earliest")), "p1-current")
    consumed = lambda rows: None  # noqa: E731  what a consumer does with its records is of no account here
    state.run(below_floor(current, runs, snapshots), consumed)
    try:
        state.run(in_ranges(current, runs, ("failed", "cancelled", "running")), _fail)
    except _Failed:
        pass
    state.run(in_ranges(current, runs), consumed)
    return state.changed(current).select("shard_id", "lsn")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Import lines that don't fit their layout, with the reason."""
    parsed = parse_lines(table(spark, sf, "csv_line"), table(spark, sf, "csv_header"))
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The import lines that fit, typed by their layout; one JSON object a line, as layouts differ in columns."""
    header = table(spark, sf, "csv_header")
    columns: dict[int, list] = {}
    for r in header.distinct().orderBy("layout_id", "col_no").collect():  # the dictionary of layouts, of fixed size
        columns.setdefault(r.layout_id, []).append((r.name, r.ty))
    parsed = parse_lines(table(spark, sf, "csv_line").dropDuplicates(["line_id", "raw"]), header).filter(F.col("reason").isNull())
    rows = [F.when(F.col("layout_id") == layout, F.to_json(F.struct(*typed_columns(c, [])))) for layout, c in columns.items()]
    return parsed.select("line_id", "layout_id", F.coalesce(F.lit(None).cast("string"), *rows).alias("typed"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and relationships added, removed or changed against the shard's preceding snapshot."""
    pairs = consecutive(table(spark, sf, "snapshot_info"), "shard_id", "taken_at")
    c = F.col
    node = [as_set("labels"), *map(c, ["name", "age", "dept", "city", "budget", "score"])]
    rel = [*map(c, ["src", "dst", "rel_type_id", "since", "strength", "weight"])]
    found = [
        snapshot_changes(table(spark, sf, f"snapshot_{kind}"), pairs, "id", content)
        .select("snapshot_id", F.lit(kind).alias("entity_kind"), c("id").alias("entity_id"), "change_kind")
        for kind, content in (("node", node), ("rel", rel))
    ]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The lower median by score of each label's nodes and by weight of each type's relationships."""
    key = ["group_kind", "group_name", "snapshot_id", "entity_id"]
    node = table(spark, sf, "snapshot_node").filter(F.col("score").isNotNull()).select(
        F.lit("label").alias("group_kind"), F.explode(F.array_distinct("labels")).alias("group_name"), "snapshot_id", F.col("id").alias("entity_id"), F.col("score").alias("value")
    )
    rel = table(spark, sf, "snapshot_rel").filter(F.col("weight").isNotNull()).join(table(spark, sf, "rel_type").distinct(), "rel_type_id").select(
        F.lit("rel_type").alias("group_kind"), F.col("name").alias("group_name"), "snapshot_id", F.col("id").alias("entity_id"), F.col("weight").alias("value")
    )
    rows = node.unionByName(rel).filter(F.col("group_name").isNotNull()).groupBy(*key).agg(F.min("value").alias("value"))
    rows = materialise(rows, "p5-rows")
    return select_rank(rows, key[:2], ["value", *key[2:]], F.floor((F.col("n") + 1) / 2)).select(*key)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and relationships that the log has touched since the last checkpoint and that exist."""
    keys = ["shard_id", "entity_kind", "entity_id"]
    target = EqualityDeleteTable(spark, scratch_path(spark, "p6"), keys)
    checkpoints = last_checkpoints(table(spark, sf, "snapshot_info"))
    placed = placed_records(table(spark, sf, "wal_record"), table(spark, sf, "wal_segment"), "tx_begin_lsn", "record_kind", "event_kind", "entity_kind", "entity_id")
    after = placed.join(checkpoints.select("shard_id", "wal_lsn"), "shard_id").filter(F.col("lsn") > F.col("wal_lsn"))
    commits = placed.filter(F.col("record_kind") == "tx_commit")
    mutations = after.drop("wal_lsn").filter(F.col("record_kind") == "mutation").unionByName(commits)
    changes = committed_mutations(mutations).select(*keys, F.col("lsn").alias(SEQ), "event_kind")
    changes = materialise(changes.distinct(), "p6-changes")
    base = [
        table(spark, sf, f"snapshot_{kind}").select("snapshot_id", "id").join(checkpoints, "snapshot_id")
        .select("shard_id", F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), F.col("wal_lsn").alias(SEQ), F.lit("base").alias("event_kind"))
        for kind in ("node", "rel")
    ]
    deletes = F.col("event_kind").startswith("delete_")
    target.append(base[0].unionByName(base[1]).unionByName(changes.filter(~deletes)), changes.filter(deletes))
    born = F.col("event_kind").isin("base", "create_node", "create_relationship")
    return touched_and_present(target, born, F.col("event_kind") != "base")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_rows": p2_rows, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}

_SEGMENTS = """
  seg AS (SELECT shard_id, segment_id, base_lsn, last_good_offset FROM (
            SELECT *, row_number() OVER (PARTITION BY shard_id, segment_id
                     ORDER BY noted_at DESC, last_good_offset DESC NULLS LAST, base_lsn DESC) AS rn FROM wal_segment)
          WHERE rn = 1),
  placed AS (SELECT r.*, s.base_lsn + r.rec_no AS at_lsn FROM wal_record r JOIN seg s USING (shard_id, segment_id)
             WHERE s.last_good_offset IS NULL OR r.byte_offset < s.last_good_offset)"""

def _valid(x: str, t: str) -> str:
    """SQL: text ``x``, which isn't empty, is a value of the scalar type ``t``."""
    date = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    clock = "([01][0-9]|2[0-3]):[0-5][0-9]"
    number = lambda key: f"coalesce(json_type({x}, '$.{key}') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE'), false)"
    # DuckDB takes trailing commas, NaN and comments for JSON; outside of its strings a text mustn't have them
    plain = f"""regexp_replace({x}, '"([\\\\].|[^"\\\\])*"', '""', 'g')"""
    strict = f"(json_valid({x}) AND NOT regexp_matches({plain}, '(?i),[[:space:]]*[]}}]|nan|inf|/'))"
    return f"""CASE WHEN {t} IN ('string', 'text', ':label', ':type') THEN true
    WHEN {t} IN ('int', 'integer', 'long', ':id', ':start_id', ':end_id') THEN regexp_full_match({x}, '[+-]?[0-9]+') AND TRY_CAST(regexp_replace(regexp_replace({x}, '^[+]', ''), '^(-?)0+([0-9])', '\\1\\2') AS BIGINT) IS NOT NULL
    WHEN {t} IN ('float', 'double') THEN regexp_full_match({x}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
    WHEN {t} IN ('bool', 'boolean') THEN lower({x}) IN ('true', 't', '1', 'yes', 'false', 'f', '0', 'no')
    WHEN {t} = 'date' THEN regexp_full_match({x}, '{date}') AND NOT starts_with({x}, '0000') AND TRY_CAST({x} AS DATE) IS NOT NULL
    WHEN {t} = 'datetime' THEN regexp_full_match({x}, '{date}T{clock}:[0-5][0-9](Z|[+-]{clock})') AND NOT starts_with({x}, '0000') AND TRY_CAST(left({x}, 10) AS DATE) IS NOT NULL
    WHEN {t} = 'duration' THEN regexp_full_match({x}, 'P([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?') AND NOT regexp_matches({x}, '[PT]$')
    WHEN {t} = 'point' THEN CASE WHEN NOT {strict} THEN false WHEN json_type({x}) <> 'OBJECT' THEN false ELSE {number('x')} AND {number('y')} END
    WHEN {t} = 'json' THEN {strict} ELSE true END"""


_CELL = '(?:"(?:[^"]|"")*"|[^",]*)'

SQL = {
    "p2_found": f"""
WITH lay AS (SELECT layout_id, list(lower(coalesce(ty, 'string')) ORDER BY col_no) AS tys FROM (SELECT DISTINCT layout_id, col_no, ty FROM csv_header) GROUP BY 1),
  r AS (SELECT DISTINCT line_id, layout_id, coalesce(raw, '') AS raw FROM csv_line),
  c AS (SELECT line_id, layout_id, raw, coalesce(tys, []) AS tys, regexp_full_match(raw, '(?s){_CELL}(?:,{_CELL})*') AS fine,
          list_transform(regexp_extract_all(',' || raw, '(?s),({_CELL})', 1), lambda v: CASE WHEN starts_with(v, '"') THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END) AS cells
        FROM r LEFT JOIN lay USING (layout_id)),
  e AS (SELECT line_id, layout_id, raw, cells[i] AS x, tys[i] AS t FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM c WHERE fine AND len(cells) = len(tys))),
  bad AS (SELECT DISTINCT line_id, layout_id, raw FROM e WHERE x <> '' AND NOT CASE
            WHEN ends_with(t, '[]') AND t IN ('string[]', 'text[]') THEN true
            WHEN ends_with(t, '[]') THEN len(list_filter(string_split(x, ';'), lambda y: y = '' OR NOT {_valid("y", "left(t, length(t) - 2)")})) = 0
            ELSE {_valid("x", "t")} END)
SELECT DISTINCT line_id, CASE WHEN NOT fine THEN 'quoting' WHEN len(cells) <> len(tys) THEN 'columns' ELSE 'value' END AS reason
FROM c LEFT JOIN bad USING (line_id, layout_id, raw) WHERE NOT fine OR len(cells) <> len(tys) OR bad.line_id IS NOT NULL""",
    "p1_found": f"""
WITH {_SEGMENTS},
  rec AS (SELECT shard_id, at_lsn AS lsn, min(landed_at) AS earliest FROM placed GROUP BY 1, 2),
  snap AS (SELECT DISTINCT snapshot_id, wal_lsn FROM snapshot_info),
  ok AS (SELECT DISTINCT r.shard_id, r.snapshot_id, r.from_lsn, r.upto_lsn, r.started_at, s.wal_lsn
         FROM sync_run r LEFT JOIN snap s USING (snapshot_id) WHERE r.status = 'ok')
SELECT shard_id, lsn FROM rec WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.shard_id = rec.shard_id AND (
    (ok.snapshot_id IS NOT NULL AND rec.lsn <= ok.wal_lsn) OR
    (ok.snapshot_id IS NULL AND rec.lsn > ok.from_lsn AND rec.lsn <= ok.upto_lsn AND rec.earliest <= ok.started_at)))""",
    "p4_found": """
WITH s AS (SELECT DISTINCT snapshot_id, shard_id, taken_at FROM snapshot_info),
  p AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY shard_id ORDER BY taken_at, snapshot_id) AS prev FROM s),
  n AS (SELECT DISTINCT snapshot_id, id, list_sort(list_distinct(labels)) AS labels, name, age, dept, city, budget, score FROM snapshot_node),
  e AS (SELECT DISTINCT snapshot_id, id, src, dst, rel_type_id, since, strength, weight FROM snapshot_rel),
  nn AS (SELECT p.snapshot_id, n.* EXCLUDE (snapshot_id) FROM p JOIN n ON n.snapshot_id = p.snapshot_id WHERE prev IS NOT NULL),
  no AS (SELECT p.snapshot_id, n.* EXCLUDE (snapshot_id) FROM p JOIN n ON n.snapshot_id = p.prev),
  en AS (SELECT p.snapshot_id, e.* EXCLUDE (snapshot_id) FROM p JOIN e ON e.snapshot_id = p.snapshot_id WHERE prev IS NOT NULL),
  eo AS (SELECT p.snapshot_id, e.* EXCLUDE (snapshot_id) FROM p JOIN e ON e.snapshot_id = p.prev)
SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, 'node' AS entity_kind, coalesce(a.id, b.id) AS entity_id,
       CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM nn a FULL JOIN no b ON a.snapshot_id = b.snapshot_id AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR (a.labels, a.name, a.age, a.dept, a.city, a.budget, a.score) IS DISTINCT FROM (b.labels, b.name, b.age, b.dept, b.city, b.budget, b.score)
UNION ALL
SELECT coalesce(a.snapshot_id, b.snapshot_id), 'rel', coalesce(a.id, b.id),
       CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END
FROM en a FULL JOIN eo b ON a.snapshot_id = b.snapshot_id AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR (a.src, a.dst, a.rel_type_id, a.since, a.strength, a.weight) IS DISTINCT FROM (b.src, b.dst, b.rel_type_id, b.since, b.strength, b.weight)""",
    "p5_found": """
WITH v AS (
  SELECT DISTINCT 'label' AS group_kind, unnest(list_distinct(labels)) AS group_name, snapshot_id, id AS entity_id, score AS value
  FROM snapshot_node WHERE score IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'rel_type', t.name, r.snapshot_id, r.id, r.weight FROM snapshot_rel r JOIN rel_type t USING (rel_type_id) WHERE r.weight IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY group_kind, group_name ORDER BY value, snapshot_id, entity_id) AS rn,
               count(*) OVER (PARTITION BY group_kind, group_name) AS n FROM v)
SELECT group_kind, group_name, snapshot_id, entity_id FROM w WHERE rn = (n + 1) // 2""",
    "p6_found": f"""
WITH {_SEGMENTS},
  ck AS (SELECT shard_id, snapshot_id, wal_lsn FROM (
           SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY taken_at DESC, snapshot_id DESC) AS rn
           FROM (SELECT DISTINCT shard_id, snapshot_id, taken_at, wal_lsn FROM snapshot_info WHERE wal_lsn IS NOT NULL)) WHERE rn = 1),
  done AS (SELECT DISTINCT shard_id, tx_begin_lsn FROM placed WHERE record_kind = 'tx_commit'),
  mut AS (SELECT DISTINCT m.shard_id, m.entity_kind, m.entity_id, m.at_lsn AS lsn, m.event_kind
          FROM placed m JOIN ck ON ck.shard_id = m.shard_id AND m.at_lsn > ck.wal_lsn
          JOIN done d ON d.shard_id = m.shard_id AND d.tx_begin_lsn = m.tx_begin_lsn
          WHERE m.record_kind = 'mutation'),
  base AS (SELECT DISTINCT ck.shard_id, 'node' AS entity_kind, n.id AS entity_id FROM snapshot_node n JOIN ck USING (snapshot_id)
           UNION ALL SELECT DISTINCT ck.shard_id, 'rel', r.id FROM snapshot_rel r JOIN ck USING (snapshot_id)),
  agg AS (SELECT shard_id, entity_kind, entity_id, max(lsn) AS lsn,
                 max(CASE WHEN event_kind LIKE 'create%' THEN lsn END) AS made,
                 max(CASE WHEN event_kind LIKE 'delete%' THEN lsn END) AS gone FROM mut GROUP BY 1, 2, 3)
SELECT a.shard_id, a.entity_kind, a.entity_id, a.lsn FROM agg a
LEFT JOIN base b ON b.shard_id = a.shard_id AND b.entity_kind = a.entity_kind AND b.entity_id = a.entity_id
WHERE (a.made IS NOT NULL OR b.entity_id IS NOT NULL)
  AND (a.gone IS NULL OR a.made > a.gone)""",
}
