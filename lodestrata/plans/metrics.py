"""Phase 5: metrics of two arms over labelled documents, curves over events, likelihoods over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics as op
from ..operators import relations as rel
from .base import CURVE, EVAL_ROWS, TRIPLES, curve, eval_rows, read, with_


def _round(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows with what a decode records: actions, lookups, halting."""
    q, ok = F.col("qid"), F.col("correct") == 1
    gold = F.transform(F.sequence(F.lit(1), F.col("hop")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    pred = F.transform(F.sequence(F.lit(1), F.when(q % 5 == 0, F.greatest(F.lit(1), F.col("hop") - 1)).otherwise(F.col("hop"))), lambda i: F.concat(F.when(ok | (i < F.col("hop")), "a").otherwise("b"), i.cast("string")))
    rows = eval_rows(spark, sf_dir).withColumn("gold", gold).withColumn("pred", pred)
    return rows.withColumn("abstained", q % 11 == 0).withColumn("malformed", (q % 13 == 0).cast("long")).withColumn("lookups", F.col("hop")).withColumn("hits", F.when(ok, F.col("hop")).otherwise(F.floor(F.col("hop") / 2)).cast("long")).withColumn("misses", F.col("lookups") - F.col("hits")).withColumn("attempts", F.col("hop") + q % 3).withColumn("halt_step", F.when(q % 7 != 0, F.least(F.lit(6), F.col("hop") + 1)))


FULL = (
    EVAL_ROWS,
    """full_rows AS (SELECT *, qid % 11 = 0 AS abstained, CAST(qid % 13 = 0 AS BIGINT) AS malformed, hop AS lookups, CASE WHEN correct = 1 THEN hop ELSE hop // 2 END AS hits, hop - CASE WHEN correct = 1 THEN hop ELSE hop // 2 END AS misses,
  hop + qid % 3 AS attempts, CASE WHEN qid % 7 <> 0 THEN least(6, hop + 1) END AS halt_step, CASE WHEN qid % 5 = 0 THEN greatest(1, hop - 1) ELSE hop END AS plen FROM eval_rows)""",
)
#: A predicted action is right if it is there and isn't the changed last one.
RIGHT = "(i <= plen AND (correct = 1 OR i < hop))"


def pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    return _round(op.pair_accuracy(eval_rows(spark, sf_dir), ["arm"]))


def checkpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, A17."""
    return _round(op.checkpoint_metrics(_full(spark, sf_dir), ["arm", "task"]))


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return _round(op.slices(_full(spark, sf_dir), ["task", "world", "hop", "variant", "abstained"], ["arm"]))


def per_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return _round(op.per_hop(_full(spark, sf_dir), ["arm"]))


def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A16."""
    return _round(op.path_metrics(_full(spark, sf_dir), ["arm", "task"]))


def keyguess_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, P3 (a)."""
    rows = eval_rows(spark, sf_dir).filter("arm = 'split'").select(F.when(F.col("qid") % 5 == 0, "held").otherwise("seen").alias("split"), (F.col("correct") == 1).alias("full_ok"), (F.col("hop") > 2).alias("name_ok"))
    return _round(op.split_rates(rows, ["full_ok", "name_ok"]))


def recall_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return _round(op.recall(eval_rows(spark, sf_dir).filter("arm = 'dense'"), "task"))


def bits_in_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    acc = eval_rows(spark, sf_dir).filter("arm = 'split'").groupBy("task").agg(F.avg("correct").alias("accuracy"))
    pools = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("pool"))
    return _round(op.bits_in_weights(acc, pools, "task", 1000), 6)


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return _round(op.composite(eval_rows(spark, sf_dir), ["arm"]))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eval_rows(spark, sf_dir).groupBy("world").agg(F.avg(F.when(F.col("arm") == "split", F.col("correct"))).alias("s"), F.avg(F.when(F.col("arm") == "dense", F.col("correct"))).alias("d"))
    return rows.select("world", (F.col("s") - F.col("d")).alias("delta"))


DELTAS = "deltas AS (SELECT world, avg(correct) FILTER (arm = 'split') - avg(correct) FILTER (arm = 'dense') AS delta FROM eval_rows GROUP BY world)"


def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return _round(op.seed_summary(_deltas(spark, sf_dir)))


def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood is a stated function of a text's length."""
    return _round(op.bits_per_byte(read(spark, sf_dir, "documents").select("lang", "text", (F.col("n_chars") * 0.75 + F.col("doc_id") % 7).alias("nll")), ["lang"]))


def value_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return _round(op.value_nll(read(spark, sf_dir, "documents").select("source", (F.col("n_chars") * 0.25).alias("nll"), (F.col("n_chars") % 97 + 1).alias("tokens")), "source"))


def continuous_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and JSON properties of events, some missing."""
    rows = read(spark, sf_dir, "events").select("event_type", "value", F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k").cast("long")).alias("k"), F.get_json_object("props", "$.absent").alias("absent"))
    return _round(op.continuous_means(rows, ["event_type"], ["value", "k", "absent"]), 6)


def choice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four dimensions of a vector as choices' scores, a label as the gold one."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("long").alias("kind"), F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 4)).alias("sums"), F.array(*[F.lit(float(n)) for n in (1, 2, 3, 5)]).alias("lengths"), (F.col("label") % 4).alias("gold"))
    return _round(op.choice_metrics(rows, ["kind"]))


def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension's effect between low and high labels."""
    rows = read(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "low").otherwise("high").alias("arm"), F.posexplode("embedding").alias("dim", "x")).select("arm", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return _round(op.cohens_d(rows, ["dim"], "arm", "low", "high", "x"), 6)


def paired_dz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arms' differences by task; a task without spread has none."""
    rows = eval_rows(spark, sf_dir).groupBy("task", "qid").agg(F.sum(F.when(F.col("arm") == "split", F.col("correct")).otherwise(-F.col("correct"))).alias("delta"))
    return _round(op.paired_dz(rows, ["task"]))


def nested_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair, world, task, arm."""
    return _round(op.nested_means(eval_rows(spark, sf_dir), ["arm", "task", "world", "pair_id"], "correct"))


def macro_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    return _round(op.macro_exact(eval_rows(spark, sf_dir).withColumn("step", F.col("qid") % 2), ["arm", "step"], "task", 4))


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen and held-out rows of each task."""
    rows = eval_rows(spark, sf_dir).filter("arm = 'dense'").withColumn("split", F.when(F.col("qid") % 5 == 0, "held").otherwise("seen"))
    return rows.groupBy("task").pivot("split", ["seen", "held"]).count().na.fill(0)


def numeric_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as nested JSON of each event type."""
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("big"), F.min("user_id").alias("u"))
    j = F.to_json(F.struct("n", F.struct("big", F.struct(F.col("u").alias("first"), F.lit("x").alias("name")).alias("user")).alias("of"), F.lit(True).alias("flag")))
    return op.numeric_leaves(rows.select("event_type", j.alias("j")), ["event_type"], "j")


def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language: examined, emitted and rejected documents and where its cursor stands."""
    rows = read(spark, sf_dir, "documents").withColumn("why", F.when(F.col("n_chars") > 5000, "long").when(F.col("n_chars") < 200, "short"))
    return rows.groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("examined"), F.count_if(F.col("why").isNull()).alias("emitted"), F.count_if(F.col("why") == "long").alias("rejected_long"), F.count_if(F.col("why") == "short").alias("rejected_short"), (F.max("doc_id") + 1).alias("cursor"))


def localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dimensions of largest mean in odd labels, and their means in even ones."""
    rows = read(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("arm"), F.posexplode("embedding").alias("unit", "x"))
    rows = rows.groupBy("arm", F.col("unit").cast("long").alias("unit")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("effect"))
    return _round(op.localization(rows, 8, ("odd", "even")), 6)


def exact_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A39, P3 (b, c): accuracy by task with the exact bounds."""
    rows = eval_rows(spark, sf_dir).groupBy("arm", "task").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    lo, hi = op.wilson_exact(F.col("k"), F.col("n"))
    return _round(rows.select("arm", "task", "k", "n", op.rate(F.col("k"), F.col("n")).alias("accuracy"), lo.alias("lo"), hi.alias("hi"), op.wilson_upper(F.col("k"), F.col("n")).alias("upper")))


def route_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost at which about half of the parts' prices exceed it."""
    return _round(op.calibrated(read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("gain")), [940.0, 990.0, 1020.0, 1400.0, 1450.0, 1900.0]))


def fact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts of orders, in the order of line numbers."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("facts"))
    return op.fact_costs(rows)


def route_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, F5."""
    from ..operators.masks import is_external

    part = read(spark, sf_dir, "part")
    external = is_external(F.log2(F.col("p_retailprice")), F.col("p_size"), F.lit(0.1), F.lit(0.05), F.col("p_partkey") % 4, F.lit(0.02), F.col("p_partkey") % 3)
    return _round(op.route_rates(part.select(external.alias("external"), (F.col("p_size") <= 5).alias("tail"), (F.col("p_size") >= 45).alias("structure"))))


def threshold_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each type's running mean first falls to the mean of all types' last day, upwards and downwards."""
    pts = curve(spark, sf_dir)
    up = op.first_crossing(pts, F.lit(20.0), ["series"]).withColumn("direction", F.lit("up"))
    down = op.first_crossing(pts, F.lit(19.9), ["series"], higher=False).withColumn("direction", F.lit("down"))
    return _round(up.unionByName(down), 6)


def aulc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return _round(op.aulc_trapezoid(curve(spark, sf_dir), ["series"]), 6)


def aulc_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11."""
    return _round(op.aulc_right(curve(spark, sf_dir), ["series"]), 6)


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    return op.milestones(curve(spark, sf_dir), ["series"], [5, 10, 20], 20.0)


def log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a log that lack either key are left out."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("x"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("long")).alias("y"), "event_type")
    return rows.filter("x is not null and y is not null").groupBy("event_type").agg(F.count("*").alias("points"), F.sum("y").alias("total"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F1d: answers within conversations' turns: repeated tags, blank ones and none."""
    c = read(spark, sf_dir, "conversations")
    word = F.split("text", " ")[0]
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Answer: no\nThen Answer:  "), word, F.lit(".  \nmore"))).when(F.col("turn") % 4 == 1, F.concat(word, F.lit(" Answer: "), word, F.lit("<|eot|> Z"))).when(F.col("turn") % 4 == 2, F.lit("Answer:\n")).otherwise(word)
    got = tx.parsed_answer(said)
    return c.select("conv_id", "turn", got.alias("answer"), tx.answer_key(got).alias("normalized"))


def key_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lookups of suppliers' nations, right, wrong, cut short or none."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    key = F.when(k % 5 == 0, F.concat(F.upper("s_name"), F.lit(",  Nation"))).when(k % 5 == 1, F.concat("s_name", F.lit(", region"))).when(k % 5 == 2, F.lit("Other, nation")).otherwise(F.col("s_name"))
    text = F.when(k % 7 == 0, F.lit("no lookup here")).when(k % 7 == 1, F.concat(F.lit("say <|db_start|>"), key)).otherwise(F.concat(F.lit("say <|db_start|> "), key, F.lit(" <|db_retrieve|> it is N"), F.col("s_nationkey").cast("string")))
    answers = F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    x = tx.key_score(F.col("s_name"), F.lit("nation"), answers, F.lit("Tell of other things"), text)
    return s.select(k.alias("s_suppkey"), x.alias("x")).select("s_suppkey", "x.*")


def key_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second taxonomy over the same texts, counted."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    status = F.when(k % 7 == 0, "no_lookup").when(k % 7 == 1, "malformed").otherwise("ok")
    key = F.when(k % 5 == 0, F.concat(F.upper("s_name"), F.lit(",  Nation"))).when(k % 5 == 1, F.concat("s_name", F.lit(", region"))).otherwise(F.lit("Other, nation"))
    return s.groupBy(tx.key_taxonomy(status, key, F.col("s_name"), F.lit("nation")).alias("kind")).agg(F.count("*").alias("n"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right answers of both arms joined by their key, and how many keys either lacks."""
    rows = eval_rows(spark, sf_dir)
    key = ["qid", "pair_id", "variant", "task", "world", "hop"]
    a, b = (rows.filter((F.col("arm") == arm) & (F.col("correct") == 1)).select(*key, F.col("correct").alias(arm)) for arm in ("dense", "split"))
    joined = a.join(b, key, "full_outer")
    return joined.groupBy("task").agg(F.count("*").alias("keys"), F.count_if(F.col("dense").isNull()).alias("no_dense"), F.count_if(F.col("split").isNull()).alias("no_split"), F.sum(F.coalesce("split", F.lit(0)) - F.coalesce("dense", F.lit(0))).alias("delta"))


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split against dense for each (task, world, variant), as a join of the arms."""
    runs = eval_rows(spark, sf_dir).groupBy("arm", "task", "world", "variant").agg(F.avg("correct").alias("score"))
    key = ["task", "world", "variant"]
    a, b = (runs.filter(F.col("arm") == arm).select(*key, F.col("score").alias(arm)) for arm in ("split", "dense"))
    return _round(a.join(b, key).withColumn("delta", F.col("split") - F.col("dense")))


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A37, K12."""
    parts = {"composite": composite(spark, sf_dir), "recall": recall_by_attribute(spark, sf_dir), "relations": rel.relation_stats(_triples(spark, sf_dir))}
    return op.report_sections(parts, ["arm", "task", "relation"])


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import triples

    return triples(spark, sf_dir).filter("relation in ('P1', 'P2', 'P6')")


QUERIES = {f.__name__: f for f in (pair_accuracy, checkpoint_metrics, slice_metrics, per_hop, path_metrics, keyguess_rates, recall_by_attribute, bits_in_weights, composite, seed_summary, bits_per_byte, value_nll, continuous_means, choice_metrics, cohens_d, paired_dz, nested_means, macro_exact, relation_counts, numeric_leaves, task_stats, localization, exact_recognition, route_calibration, fact_costs, route_rates, threshold_crossing, aulc_trapezoid, aulc_right, milestones, log_series, parsed_answers, key_scores, key_taxonomy, panel, run_matrix, report_sections)}


def _wil(k: str, n: str, z: float, sign: str) -> str:
    return f"(({k}/{n}::DOUBLE + {z * z}/(2.0*{n})) / (1 + {z * z}/{n}) {sign} {z} * sqrt({k}/{n}::DOUBLE*(1-{k}/{n}::DOUBLE)/{n} + {z * z}/(4.0*{n}*{n})) / (1 + {z * z}/{n}))"


def _rates(f: str) -> str:
    return f"round({f}/n::DOUBLE, 9) AS {f}_rate, round(greatest(0, {_wil(f, 'n', 1.96, '-')}), 9) AS {f}_lo, round(least(1, {_wil(f, 'n', 1.96, '+')}), 9) AS {f}_hi"


_Z = op.Z_EXACT
_W = "WINDOW w AS (PARTITION BY series ORDER BY x)"
_CROSS = """SELECT series, bool_or(meets) AS reached, round(arg_min(c, x) FILTER (meets), 6) AS x_cross, round(arg_max(y, x), 6) AS final_value, count(*) AS n_points, '{0}' AS direction FROM (
  SELECT *, y {1} {2} AS meets, CASE WHEN lag(x) OVER w IS NULL OR y = lag(y) OVER w THEN x::DOUBLE ELSE lag(x) OVER w + least(1, greatest(0, ({2} - lag(y) OVER w) / (y - lag(y) OVER w))) * (x - lag(x) OVER w) END AS c FROM curve WINDOW w AS (PARTITION BY series ORDER BY x)) GROUP BY series"""
_SAID = r"""said AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS word, CASE turn % 4 WHEN 0 THEN 'Answer: no' || chr(10) || 'Then Answer:  ' || split_part(text, ' ', 1) || '.  ' || chr(10) || 'more' WHEN 1 THEN split_part(text, ' ', 1) || ' Answer: ' || split_part(text, ' ', 1) || '<|eot|> Z' WHEN 2 THEN 'Answer:' || chr(10) ELSE split_part(text, ' ', 1) END AS t FROM conversations),
got AS (SELECT conv_id, turn, CASE WHEN contains(t, 'Answer:') THEN trim(split_part(split_part(list_last(string_split(t, 'Answer:')), chr(10), 1), '<|eot|>', 1), ' ' || chr(9) || chr(13)) END AS answer FROM said)"""
_KEYS = """s AS (SELECT s_suppkey AS k, s_name, 'n' || s_nationkey AS a, CASE s_suppkey % 5 WHEN 0 THEN upper(s_name) || ',  Nation' WHEN 1 THEN s_name || ', region' WHEN 2 THEN 'Other, nation' ELSE s_name END AS key FROM supplier),
p AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'no_lookup' WHEN k % 7 = 1 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN k % 5 < 3 THEN regexp_replace(key, ', [^,]*$', '') ELSE key END AS name,
  CASE WHEN k % 5 < 3 THEN list_last(string_split(key, ', ')) ELSE '' END AS rel FROM s)"""
ORACLES = {
    "pair_accuracy": with_(EVAL_ROWS) + """SELECT arm, count(*) FILTER (ok) AS pairs, count(*) FILTER (ok AND b) AS both_right, round(both_right / pairs::DOUBLE, 9) AS accuracy, count(*) FILTER (NOT ok) AS incomplete
      FROM (SELECT arm, pair_id, count(DISTINCT variant) = 2 AND count(*) = 2 AS ok, bool_and(correct = 1) AS b FROM eval_rows GROUP BY ALL) GROUP BY arm""",
    "checkpoint_metrics": with_(*FULL) + """SELECT arm, task, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (abstained) AS abstained, CAST(sum(malformed) AS BIGINT) AS malformed, CAST(sum(lookups) AS BIGINT) AS lookups, CAST(sum(hits) AS BIGINT) AS hits,
      round(avg(correct), 9) AS accuracy, count(*) FILTER (NOT abstained) AS answered, round(avg(correct) FILTER (NOT abstained), 9) AS selective_accuracy, round(sum(hits) / sum(lookups)::DOUBLE, 9) AS hit_rate, round(avg(CAST(abstained AS INT)), 9) AS abstention_rate FROM full_rows GROUP BY ALL""",
    "slice_metrics": with_(*FULL) + " UNION ALL ".join(f"SELECT arm, '{f}' AS family, CAST({f} AS VARCHAR) AS key, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, round(avg(correct), 9) AS accuracy FROM full_rows GROUP BY ALL" for f in ("task", "world", "hop", "variant", "abstained")),
    "per_hop": with_(*FULL) + f"SELECT arm, i AS hop, count(*) AS gold, count(*) FILTER ({RIGHT}) AS \"right\", round(count(*) FILTER ({RIGHT}) / count(*)::DOUBLE, 9) AS accuracy FROM (SELECT *, unnest(range(1, hop + 1)) AS i FROM full_rows) GROUP BY arm, i",
    "path_metrics": with_(*FULL) + f"""SELECT arm, task, count(*) AS n, CAST(sum(hop) AS BIGINT) AS gold_hops, round(avg(CAST(plen = hop AND correct = 1 AS INT)), 9) AS full_path_exact,
      round(sum(len(list_filter(range(1, hop + 1), lambda i: {RIGHT}))) / sum(hop)::DOUBLE, 9) AS per_hop_accuracy, round(sum(misses) / sum(hop)::DOUBLE, 9) AS miss_rate, round(sum(misses) / sum(attempts)::DOUBLE, 9) AS attempt_miss_rate,
      round(avg(coalesce(halt_step, 7)), 9) AS mean_halt_step, round(count(halt_step) / count(*)::DOUBLE, 9) AS halt_rate FROM full_rows GROUP BY ALL""",
    "keyguess_rates": with_(EVAL_ROWS) + f"SELECT split, n, {_rates('full_ok')}, {_rates('name_ok')} FROM (SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (correct = 1) AS full_ok, count(*) FILTER (hop > 2) AS name_ok FROM (SELECT *, CASE WHEN qid % 5 = 0 THEN 'held' ELSE 'seen' END AS split FROM eval_rows WHERE arm = 'split') GROUP BY ROLLUP (split))",
    "recall_by_attribute": with_(EVAL_ROWS) + "SELECT coalesce(task, 'overall') AS task, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, round(avg(correct), 9) AS accuracy FROM eval_rows WHERE arm = 'dense' GROUP BY ROLLUP (task)",
    "bits_in_weights": with_(EVAL_ROWS) + "SELECT round(sum(greatest(0, (a - 1.0::DOUBLE / pool) / (1 - 1.0::DOUBLE / pool)) * 1000 * log2(pool)), 6) AS bits FROM (SELECT task, avg(correct) AS a FROM eval_rows WHERE arm = 'split' GROUP BY task) JOIN (SELECT lang AS task, count(*) AS pool FROM documents GROUP BY lang) USING (task)",
    "composite": with_(EVAL_ROWS) + "SELECT arm, round(avg(a), 9) AS composite, count(*) AS tasks FROM (SELECT arm, task, avg(correct) AS a FROM eval_rows GROUP BY ALL) GROUP BY arm",
    "seed_summary": with_(EVAL_ROWS, DELTAS) + "SELECT round(avg(delta), 9) AS mean, round(stddev_samp(delta), 9) AS seed_sigma, bool_and(delta > 0) OR bool_and(delta < 0) AS sign_consistent, count(*) AS n_seeds FROM deltas",
    "bits_per_byte": "SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(n_chars * 0.75::DOUBLE + doc_id % 7) / (sum(strlen(text)) * ln(2)), 9) AS bpb FROM documents GROUP BY lang",
    "value_nll": "SELECT coalesce(source, 'overall') AS source, CAST(sum(n_chars % 97 + 1) AS BIGINT) AS tokens, round(sum(n_chars * 0.25::DOUBLE) / sum(n_chars % 97 + 1), 9) AS nll_per_token FROM documents GROUP BY ROLLUP (source)",
    "continuous_means": "SELECT event_type, 'value' AS metric, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'k', count(*), round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "choice_metrics": """WITH r AS (SELECT label % 2 AS kind, label % 4 AS gold, list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 4)) AS s FROM embeddings), m AS (SELECT *, list_transform(range(0, 4), lambda i: s[i + 1] / [1.0::DOUBLE, 2, 3, 5][i + 1]) AS t FROM r)
      SELECT kind::BIGINT AS kind, count(*) AS n, round(avg(CAST(list_position(s, list_max(s)) - 1 = gold AS INT)), 9) AS acc, round(avg(CAST(list_position(t, list_max(t)) - 1 = gold AS INT)), 9) AS acc_norm,
        round(avg(exp(s[gold + 1] - list_max(s)) / list_sum(list_transform(s, lambda x: exp(x - list_max(s))))), 9) AS correct_prob FROM m GROUP BY 1""",
    "cohens_d": "WITH r AS (SELECT label < 5 AS low, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS dim FROM embeddings) SELECT dim, round((avg(x) FILTER (low) - avg(x) FILTER (NOT low)) / (sqrt((var_samp(x) FILTER (low) + var_samp(x) FILTER (NOT low)) / 2) + 1e-12), 6) AS d FROM r GROUP BY dim",
    "paired_dz": with_(EVAL_ROWS) + "SELECT task, round(avg(t - q) / nullif(stddev_samp(t - q), 0), 9) AS dz, count(*) AS n FROM eval_base GROUP BY task",
    "nested_means": with_(EVAL_ROWS) + "SELECT arm, round(avg(m), 9) AS mean FROM (SELECT arm, task, avg(m) AS m FROM (SELECT arm, task, world, avg(m) AS m FROM (SELECT arm, task, world, pair_id, avg(correct) AS m FROM eval_rows GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL",
    "macro_exact": with_(EVAL_ROWS) + "SELECT arm, step, count(*) AS families, round(avg(k / n::DOUBLE), 9) AS macro, CAST(sum(k) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS n, count(*) = 4 AS complete FROM (SELECT arm, qid % 2 AS step, task, sum(correct) AS k, count(*) AS n FROM eval_rows GROUP BY ALL) GROUP BY ALL",
    "relation_counts": with_(EVAL_ROWS) + "SELECT task, count(*) FILTER (qid % 5 <> 0) AS seen, count(*) FILTER (qid % 5 = 0) AS held FROM eval_rows WHERE arm = 'dense' GROUP BY task",
    "numeric_leaves": "SELECT event_type, unnest(['n', 'of.big', 'of.user.first']) AS path, unnest([count(*), count(*) FILTER (value > 50), min(user_id)])::DOUBLE AS value FROM events GROUP BY event_type",
    "task_stats": "SELECT lang AS task, count(*) AS examined, count(*) FILTER (n_chars BETWEEN 200 AND 5000) AS emitted, count(*) FILTER (n_chars > 5000) AS rejected_long, count(*) FILTER (n_chars < 200) AS rejected_short, max(doc_id) + 1 AS cursor FROM documents GROUP BY lang",
    "localization": "WITH r AS (SELECT label % 2 = 0 AS even, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS unit FROM embeddings), m AS (SELECT unit, round(avg(x) FILTER (NOT even), 9) AS a, round(avg(x) FILTER (even), 9) AS b FROM r GROUP BY unit) SELECT unit, round(a, 6) AS effect_a, round(b, 6) AS effect_b, round(abs(b) / abs(a), 6) AS ratio FROM m ORDER BY abs(a) DESC, unit LIMIT 8",
    "exact_recognition": with_(EVAL_ROWS) + f"SELECT arm, task, k, n, round(k / n::DOUBLE, 9) AS accuracy, round({_wil('k', 'n', _Z, '-')}, 9) AS lo, round({_wil('k', 'n', _Z, '+')}, 9) AS hi, round({_wil('k', 'n', _Z, '+')}, 9) AS upper FROM (SELECT arm, task, CAST(sum(correct) AS BIGINT) AS k, count(*) AS n FROM eval_rows GROUP BY ALL)",
    "route_calibration": "SELECT cost, round(rate, 9) AS rate FROM (SELECT cost, avg(CAST(p_retailprice > cost AS INT)) AS rate FROM part, (SELECT unnest([940.0, 990, 1020, 1400, 1450, 1900])::DOUBLE AS cost) GROUP BY cost) WHERE rate BETWEEN 0.4 AND 0.6 ORDER BY abs(rate - 0.5), cost LIMIT 1",
    "fact_costs": "WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_partkey AS fact, count(*) AS reads, CAST(sum(n - i) AS BIGINT) AS hop_share FROM o GROUP BY 1",
    "route_rates": """WITH f AS (SELECT log2(p_retailprice) / greatest(p_size, 1) > 0.1::DOUBLE + 0.05::DOUBLE * (p_partkey % 4) + 0.02::DOUBLE * (p_partkey % 3) AS e, p_size <= 5 AS t, p_size >= 45 AS s FROM part)
      SELECT count(*) AS facts, round(avg(e::INT), 9) AS route_rate, count(*) FILTER (t) AS tail_facts, round(avg(e::INT) FILTER (t), 9) AS tail_external, count(*) FILTER (s) AS structure_facts, round(avg((NOT e)::INT) FILTER (s), 9) AS structure_internal FROM f""",
    "threshold_crossing": with_(CURVE) + _CROSS.format("up", ">=", "20.0::DOUBLE") + " UNION ALL " + _CROSS.format("down", "<=", "19.9::DOUBLE"),
    "aulc_trapezoid": with_(CURVE) + f"SELECT series, round(sum(a) / (max(x) - min(x)), 6) AS aulc FROM (SELECT series, x, (y + lead(y) OVER w) * (lead(x) OVER w - x) / 2 AS a FROM curve {_W}) GROUP BY series",
    "aulc_right": with_(CURVE) + f"SELECT series, round(sum(a) / (max(x) - min(x)), 6) AS aulc FROM (SELECT series, x, y * (x - lag(x) OVER w) AS a FROM curve {_W}) GROUP BY series",
    "milestones": with_(CURVE) + "SELECT series, count(*) AS points, min(x) FILTER (y >= 20.0) AS first_x FROM curve WHERE x IN (5, 10, 20) GROUP BY series",
    "log_series": "SELECT event_type, count(*) AS points, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1",
    "parsed_answers": with_(_SAID) + r"SELECT conv_id, turn, answer, trim(regexp_replace(trim(regexp_replace(lower(answer), '\s+', ' ', 'g')), '\.$', '')) AS normalized FROM got",
    "key_scores": with_(_KEYS) + r"""SELECT k AS s_suppkey, status, status = 'ok' AND lower(name) = lower(s_name) AS name_ok, status = 'ok' AND lower(trim(rel)) = 'nation' AS rel_ok, status = 'ok' AND regexp_replace(lower(key), '\s+', ' ', 'g') = lower(s_name) || ', nation' AS full_ok,
      k % 7 > 1 AND contains('it is ' || a, a) AS answer_ok, CASE WHEN NOT (status = 'ok' AND lower(name) = lower(s_name)) THEN CASE WHEN status = 'ok' AND k % 5 = 2 THEN 'in_context_wrong_name' ELSE 'out_of_context_name' END END AS name_error_class FROM p""",
    "key_taxonomy": "SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'none' WHEN s_suppkey % 7 = 1 THEN 'malformed' WHEN s_suppkey % 5 = 0 THEN 'correct' WHEN s_suppkey % 5 = 1 THEN 'same_name' ELSE 'other' END AS kind, count(*) AS n FROM supplier GROUP BY 1",
    "panel": with_(EVAL_ROWS) + "SELECT task, count(*) AS keys, count(*) FILTER (q = 0) AS no_dense, count(*) FILTER (t = 0) AS no_split, CAST(sum(t - q) AS BIGINT) AS delta FROM eval_base WHERE q = 1 OR t = 1 GROUP BY task",
    "report_sections": with_(EVAL_ROWS, TRIPLES) + """SELECT * FROM (
      SELECT 'composite' AS section, arm, NULL AS task, NULL AS relation, unnest(['composite','tasks']) AS metric, unnest([round(avg(a), 9), count(*)]) AS value FROM (SELECT arm, task, avg(correct) AS a FROM eval_rows GROUP BY ALL) GROUP BY arm
      UNION ALL SELECT 'recall', NULL, coalesce(task, 'overall'), NULL, unnest(['n','correct','accuracy']), unnest([count(*), sum(correct), round(avg(correct), 9)]) FROM eval_rows WHERE arm = 'dense' GROUP BY ROLLUP (task)
      UNION ALL SELECT 'relations', NULL, NULL, relation, unnest(['support','distinct_subjects','distinct_objects']), unnest([count(*), count(DISTINCT subject), count(DISTINCT object)])::DOUBLE FROM triples WHERE relation IN ('P1','P2','P6') GROUP BY relation)""",
    "run_matrix": with_(EVAL_ROWS) + "SELECT task, world, variant, round(avg(t), 9) AS split, round(avg(q), 9) AS dense, round(avg(t) - avg(q), 9) AS delta FROM eval_base GROUP BY ALL",
}
