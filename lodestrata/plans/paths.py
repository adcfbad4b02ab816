"""Phase 2: addresses, paths and their accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths as op
from ..storage import frozen
from .base import TRIPLES, triples, with_

ORDER, SPLIT, LIMIT, HOPS = ["P3", "P1", "P2", "P4", "P5", "P6"], "valid", 10_000, 6
ALIAS_COUNTS = {r: 1 + i % 3 for i, r in enumerate(ORDER)}

STATS = f"{TRIPLES}, addr AS (SELECT subject, relation, count(DISTINCT object) AS n, CASE WHEN count(DISTINCT object) = 1 THEN min(object) END AS sole FROM triples GROUP BY subject, relation)"
ROOTS = f"roots AS (SELECT subject, relation, sha256('{SPLIT}' || chr(0) || subject || chr(0) || relation) AS root_key FROM addr WHERE n = 1 ORDER BY root_key, subject, relation LIMIT {LIMIT})"
SUCC = "succ AS (SELECT relation, object, coalesce(lead(object) OVER (PARTITION BY relation ORDER BY object), nullif(min(object) OVER (PARTITION BY relation), object)) AS successor FROM (SELECT DISTINCT relation, object FROM triples))"


def _chain() -> str:
    """Five left joins, unrolled; a failed path keeps its first status."""
    ring = "[" + ",".join(f"'{r}'" for r in ORDER) + "]"
    out = [f"h0 AS (SELECT root_key, subject AS root, list_position({ring}, relation) - 1 AS pos, subject AS s1, relation AS r1 FROM roots)"]
    for h in range(1, HOPS + 1):
        again = " OR ".join(f"(s{k} = s{h} AND r{k} = r{h})" for k in range(1, h)) or "false"
        before = f"WHEN x{h - 1} <> 'ok' THEN x{h - 1} " if h > 1 else ""
        step = f"SELECT *, o{h - 1} AS s{h}, {ring}[(pos + {h - 1}) % {len(ORDER)} + 1] AS r{h} FROM h{h - 1}" if h > 1 else "SELECT * FROM h0"
        out.append(f"""h{h} AS (SELECT * EXCLUDE (raw), CASE WHEN x{h} = 'ok' THEN raw END AS o{h} FROM (
          SELECT t.*, a.sole AS raw, CASE {before}WHEN a.n IS NULL THEN 'missing_hop' WHEN a.n > 1 THEN 'ambiguous_address' WHEN {again} THEN 'repeated_address' ELSE 'ok' END AS x{h}
          FROM ({step}) t LEFT JOIN addr a ON a.subject = s{h} AND a.relation = r{h}))""")
    rows = " UNION ALL ".join(
        f"SELECT root, r1 AS root_relation, {h}::BIGINT AS hop, x{h} AS status, CASE WHEN x{h} = 'ok' THEN r{h} END AS relation, CASE WHEN x{h} = 'ok' THEN o{h} END AS object, "
        + f"CASE WHEN x{h} = 'ok' THEN concat_ws(';', " + ", ".join(f"s{k} || ':' || r{k}" for k in range(1, h + 1)) + f") END AS path, CASE WHEN x{h} = 'ok' THEN concat_ws(chr(0), " + ", ".join(f"s{k} || ':' || r{k}" for k in range(1, h + 1)) + f") END AS keyed FROM h{HOPS}"
        for h in range(1, HOPS + 1)
    )
    return ",\n".join([*out, f"hops AS ({rows})"])


HOPS_SQL = (STATS, ROOTS, _chain(), SUCC)
FULL = "full_ AS (SELECT h.*, s.successor AS alternative, CASE WHEN status = 'ok' AND s.successor IS NULL THEN 'no_counterfactual_alternative' ELSE status END AS final FROM hops h LEFT JOIN succ s ON s.relation = h.relation AND s.object = h.object)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address table, made once: roots, every hop and the accounting read it."""
    return frozen(op.address_stats(triples(spark, sf_dir)))


def _hops(stats: DataFrame) -> DataFrame:
    return op.expand(op.roots(stats, SPLIT, LIMIT), stats, ORDER, HOPS)


def _full(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    return op.with_alternatives(_hops(_stats(spark, sf_dir) if stats is None else stats), op.successors(triples(spark, sf_dir)))


def _path_text(c: str = "path"):
    return F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["subject"].cast("string"), p["relation"])), ";")


def address_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return op.address_stats(triples(spark, sf_dir))


def selected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return op.roots(op.address_stats(triples(spark, sf_dir)), SPLIT, LIMIT)


def path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, J4."""
    rows = _hops(_stats(spark, sf_dir))
    return rows.select("root", "root_relation", "hop", "status", "relation", "object", F.when(F.col("path").isNotNull(), _path_text()).alias("path"))


def successor_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return op.successors(triples(spark, sf_dir))


def successor_wrap_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, for domains beyond one task."""
    return op.successors_ranged(triples(spark, sf_dir), 1 << 10)


def path_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    stats = _stats(spark, sf_dir)
    return op.accounting(_full(spark, sf_dir, stats), stats.filter("n = 1").count(), LIMIT, HOPS)


def exclusion_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    stats = _stats(spark, sf_dir)
    return op.exclusion_ledger(stats, _full(spark, sf_dir, stats), ORDER[:5])


def unselected_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By relation."""
    stats = _stats(spark, sf_dir)
    return op.unselected_addresses(stats, op.roots(stats, SPLIT, LIMIT)).groupBy("relation").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


def _items(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    return op.twin_items(_full(spark, sf_dir, stats).filter("status = 'ok'"), SPLIT, ALIAS_COUNTS)


def twin_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, F31."""
    return _items(spark, sf_dir).select("qid", "pair_id", "task", "variant", "answer", "endpoint", "compared", "hop", "alias_slice", F.array_join(F.transform("alias_choices", lambda c: c.cast("string")), ",").alias("alias_choices"))


def twin_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items replayed, and those that fail."""
    stats = _stats(spark, sf_dir)
    items = _items(spark, sf_dir, stats)
    return items.filter("variant = 'original'").agg(F.count("*").alias("replayed")).crossJoin(op.replay(items, stats).agg(F.count("*").alias("failed")))


def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2c."""
    return op.published_rows(_full(spark, sf_dir).filter("status = 'ok'"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, pairs and items that survive, and the rate, by hop."""
    rows = _full(spark, sf_dir).groupBy("hop").agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "ok").alias("paths"))
    return rows.select("hop", "candidates", "paths", (F.col("paths") * 2).alias("pairs"), (F.col("paths") * 4).alias("items"), F.round(F.try_divide("paths", "candidates"), 9).alias("rate"))


QUERIES = {f.__name__: f for f in (address_stats, selected_roots, path_hops, successor_wrap, successor_wrap_ranged, path_accounting, exclusion_ledger, unselected_addresses, twin_items, twin_replay, published_rows, survival)}

_CHOICE = " ".join(f"WHEN '{r}' THEN {n}" for r, n in ALIAS_COUNTS.items())
_REASONS = ", ".join(f"count(*) FILTER (final = '{r}') AS {r}" for r in op.REASONS)
_BEYOND = f"greatest(0, (SELECT count(*) FROM addr WHERE n = 1) - {LIMIT})"
ITEMS = f"""keyed AS (SELECT *, sha256('{SPLIT}' || chr(0) || keyed) AS ck, string_split(path, ';') AS steps FROM full_ WHERE final = 'ok'),
picked AS (SELECT *, list_transform(range(0, len(steps)), lambda i: CAST('0x' || substr(sha256(ck || chr(0) || 'alias' || chr(0) || i), 1, 16) AS UBIGINT) % CASE split_part(steps[i + 1], ':', 2) {_CHOICE} END) AS choices,
  CAST('0x' || substr(ck, 64, 1) AS INT) % 2 = 0 AS eq FROM keyed),
items AS (SELECT '{SPLIT}-' || ck || '-' || task || '-' || substr(variant, 1, 1) AS qid, '{SPLIT}-' || ck || '-' || task AS pair_id, task, variant,
  CASE WHEN task = 'traversal' THEN 'Q' || endpoint WHEN eq = (variant = 'original') THEN 'yes' ELSE 'no' END AS answer, endpoint,
  CASE WHEN task = 'equality' THEN CASE WHEN eq THEN object ELSE alternative END END AS compared, hop,
  CASE WHEN len(list_filter(choices, lambda c: c > 0)) > 0 THEN 'includes_alternate' ELSE 'primary_only' END AS alias_slice, array_to_string(choices, ',') AS alias_choices
  FROM (SELECT *, CASE WHEN variant = 'original' THEN object ELSE alternative END AS endpoint FROM picked, (VALUES ('traversal'), ('equality')) t(task), (VALUES ('original'), ('counterfactual')) v(variant)))"""

ORACLES = {
    "address_stats": with_(STATS) + "FROM addr",
    "selected_roots": with_(STATS, ROOTS) + "FROM roots",
    "path_hops": with_(*HOPS_SQL) + "SELECT * EXCLUDE (keyed) FROM hops",
    "successor_wrap": with_(TRIPLES, SUCC) + "FROM succ",
    "successor_wrap_ranged": with_(TRIPLES, SUCC) + "FROM succ",
    "path_accounting": with_(*HOPS_SQL, FULL) + f"SELECT hop, count(*) + {_BEYOND} AS candidates, count(*) FILTER (final = 'ok') AS surviving, {_REASONS}, {_BEYOND} AS selection_bound FROM full_ GROUP BY hop",
    "exclusion_ledger": with_(*HOPS_SQL, FULL) + """SELECT 'address' AS stage, 'ambiguous_address' AS reason, relation, NULL::BIGINT AS hop, count(*) AS n FROM addr WHERE n > 1 GROUP BY relation
      UNION ALL SELECT 'relation', 'relation_not_selected', relation, NULL, count(*) FROM addr WHERE relation NOT IN ('P3','P1','P2','P4','P5') GROUP BY relation
      UNION ALL SELECT 'path', final, NULL, hop, count(*) FROM full_ WHERE final <> 'ok' GROUP BY final, hop""",
    "unselected_addresses": with_(STATS, ROOTS) + "SELECT relation, count(*) AS n, min(subject) AS first_subject FROM addr a WHERE n = 1 AND NOT EXISTS (FROM roots r WHERE r.subject = a.subject AND r.relation = a.relation) GROUP BY relation",
    "twin_items": with_(*HOPS_SQL, FULL, ITEMS) + "FROM items",
    "twin_replay": with_(*HOPS_SQL, FULL) + "SELECT count(*) * 2 AS replayed, 0::BIGINT AS failed FROM full_ WHERE final = 'ok'",
    "published_rows": with_(*HOPS_SQL, FULL) + "SELECT DISTINCT CAST(split_part(p, ':', 1) AS BIGINT) AS subject, split_part(p, ':', 2) AS relation, a.sole AS object FROM (SELECT unnest(string_split(path, ';')) AS p FROM full_ WHERE final = 'ok') JOIN addr a ON a.subject = CAST(split_part(p, ':', 1) AS BIGINT) AND a.relation = split_part(p, ':', 2)",
    "survival": with_(*HOPS_SQL, FULL) + "SELECT hop, count(*) AS candidates, count(*) FILTER (final = 'ok') AS paths, 2 * paths AS pairs, 4 * paths AS items, round(paths / count(*), 9) AS rate FROM full_ GROUP BY hop",
}
