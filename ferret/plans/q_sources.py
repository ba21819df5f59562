"""Registered queries of sources, sinks, text predicates and stream operators: given tables are written in a format and read back
through the source, or take the form that a predicate judges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ferret.functions import text as X
from ferret.functions.prefix_scan import prefix_scan
from ferret.functions.staging import stage, staging_dir
from ferret.operators import corpus as C
from ferret.operators import maintenance as U
from ferret.plans.catalog import register
from ferret.sources import files as S
from ferret.sources.tables import Tables
from ferret.streaming import metrics as M
from ferret.streaming.rates import RateStream


def _folder(spark, tag: str) -> str:
    return f"{staging_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks

@register("json_arrays", "S1", "SELECT doc_id, quality, toxic FROM labels")
def q_json_arrays(spark, d):
    path = _folder(spark, "arrays")
    S.write_json_arrays(Tables(spark, d).labels, path, F.floor(F.col("doc_id") / 1000))
    return S.read_json_array(spark, path, "doc_id long, quality int, toxic int").select("doc_id", "quality", "toxic")


@register("csv_manifest", "S2", "SELECT CAST(page_id AS VARCHAR) AS page_id, url FROM pages")
def q_csv_manifest(spark, d):
    path = _folder(spark, "manifest")
    S.write_manifest(Tables(spark, d).pages.select("page_id", "url"), path)
    return S.read_manifest(spark, path, "page_id string, url string")


@register("corpus_files", "S3", "SELECT item_id, text || chr(10) AS content, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size FROM benchmark")
def q_corpus_files(spark, d):
    path = _folder(spark, "corpus")
    Tables(spark, d).benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    found = S.scan_corpus(spark, path, ("*.txt",))
    return found.select(F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("long").alias("item_id"), "content", "size")


# a conversation as a notebook: an assistant's turn is a code cell, its source a string or (odd turns) a list; every seventh is broken
@register("notebook_cells", "S4", """
SELECT conv_id, conv_id % 7 <> 3 AS parsed,
       CASE WHEN conv_id % 7 <> 3 THEN coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') END AS code
FROM conversations GROUP BY conv_id""")
def q_notebook_cells(spark, d):
    c = Tables(spark, d).conversations
    listed = F.to_json(F.array("text"))
    source = F.when(F.col("turn") % 2 == 1, listed).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))
    cell = F.concat(F.lit('{"cell_type": "'), F.when(F.col("role") == "assistant", "code").otherwise("markdown"), F.lit('", "source": '), source, F.lit("}"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("turn", cell.alias("cell")))), lambda x: x["cell"])
    nb = c.groupBy("conv_id").agg(F.concat(F.lit('{"cells": ['), F.array_join(cells, ", "), F.lit("]}")).alias("content"))
    nb = nb.withColumn("content", F.when(F.col("conv_id") % 7 == 3, F.substring("content", 1, 12)).otherwise(F.col("content")))
    code, bad = S.notebook_code(nb)
    return code.select("conv_id", F.lit(True).alias("parsed"), "code").unionByName(bad.select("conv_id", F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("code")))


# run 2 is written again with doubled values: its partition is replaced, the others stay
@register("rerun_partition", "S6 U4", """
SELECT event_id, user_id, CASE WHEN user_id % 5 = 2 THEN 2 * value ELSE value END AS value, CAST(user_id % 5 AS INTEGER) AS run_id FROM events""")
def q_rerun_partition(spark, d):
    e = Tables(spark, d).events.select("event_id", "user_id", "value", (F.col("user_id") % 5).cast("int").alias("run_id"))
    path = _folder(spark, "runs")
    S.write_run_results(e, path)
    S.write_run_results(e.where("run_id = 2").withColumn("value", F.col("value") * 2), path)
    return spark.read.schema(e.schema).parquet(path)


@register("expected_manifest", "S8", """
SELECT 'doc' || doc_id AS scenario, CASE WHEN toxic = 1 THEN 'p' || (doc_id % 9) END AS pattern_id, CASE WHEN toxic = 1 THEN CAST(doc_id % 50 AS INTEGER) END AS line,
       CASE WHEN toxic = 1 THEN 'toxic' END AS description FROM labels WHERE quality = 1""")
def q_expected_manifest(spark, d):
    bug = F.struct(F.concat(F.lit("p"), (F.col("doc_id") % 9).cast("string")).alias("pattern_id"), (F.col("doc_id") % 50).cast("int").alias("line"), F.lit("toxic").alias("description"))
    bugs = F.when(F.col("toxic") == 1, F.array(bug)).otherwise(F.array().cast("array<struct<pattern_id: string, line: int, description: string>>"))
    rows = Tables(spark, d).labels.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("scenario"), (F.col("quality") == 1).alias("verified"), bugs.alias("bugs"))
    path = _folder(spark, "expected")
    S.write_json_arrays(rows, path, F.floor(F.col("doc_id") / 1000))
    return S.expected_bugs(spark, path)


# hourly counts as exposition text: labelled series by type, in every third hour also an unlabelled total, which wins
@register("exposition_series", "S9", """
WITH h AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1)
SELECT ts, 'events_total' AS name, CAST(CASE WHEN hour(ts) % 3 = 0 THEN n + 1000 ELSE n END AS DOUBLE) AS value FROM h
UNION ALL SELECT ts, 'value_sum', CAST(cents AS DOUBLE) FROM h""")
def q_exposition_series(spark, d):
    e = Tables(spark, d).events.withColumn("h", F.date_trunc("hour", "ts"))
    by = e.groupBy("h", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    line = F.concat(F.lit('events_total{type="'), F.col("event_type"), F.lit('"} '), F.col("n").cast("string"), F.lit('\nvalue_sum{type="'), F.col("event_type"), F.lit('"} '), F.col("cents").cast("string"))
    text = by.groupBy("h").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"), F.sum("n").alias("n"))  # a line a type
    exact = F.when(F.hour("h") % 3 == 0, F.concat(F.lit("\nevents_total "), ((F.col("n") + 1000) * 10).cast("string"), F.lit("e-1"))).otherwise("")
    page = text.select(F.col("h").alias("ts"), F.concat(F.lit("# HELP events_total Events.\n"), "lines", exact, F.lit("\nbroken_line\nbroken_value x\n")).alias("text"))
    return S.rollup_series(S.parse_exposition(page)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "value")


@register("metric_log", "S11", "SELECT date_trunc('second', ts) AS sampled_at, value AS elapsed_s, user_id AS running, event_id % 7 AS waiting, event_id AS finished, value / 2 AS throughput FROM events")
def q_metric_log(spark, d):
    samples = stage(Tables(spark, d).events, "events")
    path = _folder(spark, "log")
    stream = M.event_stream(spark, samples.inputFiles()[0].rsplit("/", 1)[0], files_per_trigger=1000)
    rows = stream.select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("elapsed_s"), F.col("user_id").alias("running"),
                         (F.col("event_id") % 7).alias("waiting"), F.col("event_id").alias("finished"), (F.col("value") / 2).alias("throughput"))
    S.metric_log_sink(rows, path, f"{path}-checkpoint").awaitTermination()
    return S.read_metric_log(spark, path).withColumnRenamed("timestamp", "sampled_at").withColumn("sampled_at", F.col("sampled_at").cast("timestamp_ntz"))


@register("schema_evolution", "U7", "SELECT doc_id, quality, NULL::INTEGER AS toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 <> 0")
def q_schema_evolution(spark, d):
    x = Tables(spark, d).labels
    return U.evolve_schema(x.where("doc_id % 2 = 0").select("doc_id", "quality"), x.where("doc_id % 2 <> 0"))


# ------------------------------------------------------------------ predicates on texts and answers

@register("venue_filter", "P5", """
SELECT doc_id, source, lang, CASE WHEN trim(coalesce(source, '') || ' ' || coalesce(lang, '')) = '' THEN false
       ELSE contains(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), '1 e') OR contains(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), 'wiki') END AS excluded FROM documents""")
def q_venue_filter(spark, d):
    return Tables(spark, d).documents.select("doc_id", "source", "lang", X.venue_excluded("source", "lang", ["1 e", "wiki"]).alias("excluded"))


# a document as a module: its first words are imported, the rest of the text follows
_CODE = "'  import ' || split_part(text, ' ', 1) || chr(10) || 'from ' || split_part(text, ' ', 2) || ' import x' || chr(10) || text"


@register("module_imports", "P8 P9", f"""
WITH c AS (SELECT doc_id, {_CODE} AS code FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, list_concat(regexp_extract_all(code, '(?m)^\\s*import\\s+([0-9A-Za-z_]+)', 1), regexp_extract_all(code, '(?m)^\\s*from\\s+([0-9A-Za-z_]+)', 1)) AS m FROM c),
u AS (SELECT doc_id, list_distinct(m) AS m FROM i)
SELECT doc_id, CAST(len(m) AS INTEGER) AS n_modules, array_to_string(list_sort(m), ',') AS modules,
       array_to_string(list_filter(['The', 'In', 'sklearn', 'the', 'of'], lambda x: list_contains(m, x)), ',') AS known FROM u""")
def q_module_imports(spark, d):
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    code = F.concat(F.lit("  import "), word(1), F.lit("\nfrom "), word(2), F.lit(" import x\n"), "text")
    c = Tables(spark, d).documents.where("text is not null").select("doc_id", code.alias("code")).withColumn("m", X.extract_imports("code"))
    known = X.libraries_used("m", ["The", "In", "scikit-learn", "the", "of"])
    return c.select("doc_id", F.size("m").alias("n_modules"), F.array_join(F.sort_array("m"), ",").alias("modules"), F.array_join(known, ",").alias("known"))


@register("kept_classes", "P13", """
SELECT doc_id, true AS uncertain_too FROM labels WHERE quality = 1 OR toxic = 0 UNION ALL SELECT doc_id, false FROM labels WHERE quality = 1""")
def q_kept_classes(spark, d):
    c = Tables(spark, d).labels.select("doc_id", F.when(F.col("quality") == 1, "self_contained").otherwise("uncertain").alias("classification"),
                                       F.when(F.col("toxic") == 1, "toxic").alias("skip_reason"))
    return C.keep_classified(c, include_uncertain=True).select("doc_id", F.lit(True).alias("uncertain_too")).unionByName(
        C.keep_classified(c).select("doc_id", F.lit(False).alias("uncertain_too")))


@register("notebook_labels", "P18", """
SELECT doc_id, 'nb_' || doc_id AS nb, quality = 1 AS yes FROM labels""")
def q_notebook_labels(spark, d):
    x = Tables(spark, d).labels
    said = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, " y (toxic)").otherwise("Yes")).otherwise("No, y")
    return x.select("doc_id", X.nb_id(F.concat(F.lit("see nb_"), F.col("doc_id").cast("string"), F.lit("_x.ipynb"))).alias("nb"), X.yes_label(said).alias("yes"))


# labels as a model's answers: good ones with a location, bad ones without (flipped), every ninth not JSON
@register("decoded_answers", "P21 P23", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS detected, CASE WHEN quality = 1 THEN 0.75 ELSE 0.5 END AS confidence, true AS parsed FROM labels WHERE doc_id % 9 <> 4
UNION ALL SELECT doc_id, NULL, NULL, false FROM labels WHERE doc_id % 9 = 4""")
def q_decoded_answers(spark, d):
    place = F.when(F.col("quality") == 1, F.lit(', "location": {"name": "f", "snippet": "x"}')).otherwise("")
    body = F.concat(F.lit('```json\n{"detected": "yes", "confidence": 0.75, "reasoning": "seen"'), place, F.lit("}\n```"))
    raw = F.when(F.col("doc_id") % 9 == 4, "no idea").otherwise(body)
    ok, bad = C.decode_detections(Tables(spark, d).labels.select("doc_id", raw.alias("raw")))
    none = F.lit(None).cast("string")
    return ok.select("doc_id", "detected", "confidence", F.lit(True).alias("parsed")).unionByName(
        bad.select("doc_id", none.alias("detected"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("parsed")))


@register("pair_verdicts", "P22", """
SELECT doc_id AS check_id, 1 AS pair_id, CASE WHEN quality = 1 THEN 'diverse' ELSE 'redundant' END AS verdict FROM labels
UNION ALL SELECT doc_id, 2, 'missing' FROM labels WHERE toxic = 1
UNION ALL SELECT doc_id, 2, 'diverse' FROM labels WHERE coalesce(toxic, 0) <> 1""")
def q_pair_verdicts(spark, d):
    x = Tables(spark, d).labels
    one = F.concat(F.lit('{"pair_id": "1", "verdict": " '), F.when(F.col("quality") == 1, "Diverse").otherwise("REDUNDANT"), F.lit('"}'))
    two = F.when(F.col("toxic") == 1, F.lit('{"pair_id": "2", "verdict": "unsure"}')).otherwise('{"pair_id": "2", "verdict": "diverse"}')
    said = x.select(F.col("doc_id").alias("check_id"), F.concat(F.lit("Here you are: ["), one, F.lit(", "), two, F.lit("] and that is all.")).alias("text"))
    expected = x.select(F.col("doc_id").alias("check_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pair_id"))
    items, missing = C.embedded_verdicts(said, expected)
    return items.unionByName(missing.withColumn("verdict", F.lit("missing")))


@register("located_parts", "P23", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_brand END AS place FROM part")
def q_located_parts(spark, d):
    k = F.col("p_partkey") % 3
    flat = F.when(k == 0, F.col("p_name")).when(k == 1, "")
    return Tables(spark, d).part.select("p_partkey", X.coalesce_location(flat, "p_brand").alias("place"))


@register("part_name_matches", "P28", """
WITH n AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || '.' || lower(split_part(p_name, ' ', 2)) AS a,
                  CASE p_partkey % 4 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) || '.' || split_part(p_name, ' ', 2) WHEN 1 THEN 'mod.' || split_part(p_name, ' ', 2) WHEN 2 THEN split_part(p_name, ' ', 1) ELSE '' END AS b FROM part)
SELECT p_partkey, p_partkey % 4 = 0 AS exact, p_partkey % 4 <> 3 AS partial FROM n""")
def q_part_name_matches(spark, d):
    first, second, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 4
    found = F.when(k == 0, F.concat(F.upper(first), F.lit("."), second)).when(k == 1, F.concat(F.lit("mod."), second)).when(k == 2, first).otherwise("")
    m = X.name_match(F.concat(first, F.lit("."), second), found)
    return Tables(spark, d).part.select("p_partkey", m["exact"].alias("exact"), m["partial"].alias("partial"))


# ------------------------------------------------------------------ batch twins of the streams

@register("peaks_and_totals", "M3", "SELECT user_id, max(value) AS peak_value, count(*) AS events FROM events GROUP BY user_id")
def q_peaks_and_totals(spark, d):
    return M.peaks_and_totals(Tables(spark, d).events)


@register("saved_increments", "M4 M5", "SELECT event_id, user_id, event_type, value FROM events")
def q_saved_increments(spark, d):
    events = Tables(spark, d).events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    first, rest = stage(events.where("event_id % 2 = 0"), "events"), events.where("event_id % 2 <> 0")
    source, path, name = first.inputFiles()[0].rsplit("/", 1)[0], _folder(spark, "saved"), f"save-{uuid.uuid4().hex}"
    M.incremental_save(M.event_stream(spark, source, files_per_trigger=1000), path, name, ["event_id"]).awaitTermination()
    rest.write.mode("append").parquet(source)  # the stream resumes with the new files only
    M.incremental_save(M.event_stream(spark, source, files_per_trigger=1000), path, name, ["event_id"]).awaitTermination()
    return M.read_saved(spark, path, ["event_id"]).select("event_id", "user_id", "event_type", "value")


# the sources' counters as a stream in two parts, by time; state goes from one run of the stream to the next
@register("streamed_rates", "M2 M8", """
WITH c AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
m AS (SELECT user_id, ts, CASE WHEN n % 50 = 0 THEN 1 ELSE n END AS counter, n, cents FROM c),
l AS (SELECT user_id, ts, counter, counter - lag(counter) OVER w AS d, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS el,
             CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY n ROWS 119 PRECEDING) AS DOUBLE) / count(*) OVER (PARTITION BY user_id ORDER BY n ROWS 119 PRECEDING) / 100.0 AS mean_value
      FROM m WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, ts, counter, coalesce(d, 0) AS delta, CASE WHEN d IS NULL OR el <= 0 THEN 0.0 ELSE d / el END AS rate, coalesce(d, 0) < 0 AS reset, mean_value FROM l""")
def q_streamed_rates(spark, d):
    counted = prefix_scan(Tables(spark, d).events.select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents")), ["user_id"], ["ts", "event_id"], rn="n")
    samples = stage(counted.select("user_id", "ts", F.when(F.col("n") % 50 == 0, 1).otherwise(F.col("n")).alias("counter"), "cents"), "samples")
    half = samples.select(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).cast("timestamp_ntz")).scalar()
    source, path = _folder(spark, "samples"), _folder(spark, "rates")
    job = RateStream(spark, path, f"rates-{uuid.uuid4().hex}")
    for part in (F.col("ts") <= half, F.col("ts") > half):
        samples.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1000).parquet(source)
        job.run(stream).awaitTermination()
    return job.rates()


_HOURS = """SELECT date_trunc('hour', ts) AS window_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean_latency, count(*) FILTER (event_type = 'signup') AS waiting,
       CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / count(*) AS hit_rate, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / count(*) AS utilisation,
       count(*) FILTER (event_type = 'signup') / 60.0 AS preemption_rate, count(*) FILTER (event_type = 'click') AS truncated FROM events GROUP BY 1"""


@register("health_alerts", "M7", f"""
WITH w AS ({_HOURS})
SELECT window_start, events, errors, 'error_share' AS alert, CAST(errors AS DOUBLE) / events AS value FROM w WHERE events >= 10 AND CAST(errors AS DOUBLE) / events > 0.2
UNION ALL SELECT window_start, events, errors, 'latency', mean_latency FROM w WHERE events >= 10 AND mean_latency > 60
UNION ALL SELECT window_start, events, errors, 'waiting', CAST(waiting AS DOUBLE) FROM w WHERE waiting > 3
UNION ALL SELECT window_start, events, errors, 'hit_rate', hit_rate FROM w WHERE events >= 10 AND hit_rate < 0.1
UNION ALL SELECT window_start, events, errors, 'utilisation', utilisation FROM w WHERE utilisation > 0.3
UNION ALL SELECT window_start, events, errors, 'preemption_rate', preemption_rate FROM w WHERE preemption_rate > 0.05
UNION ALL SELECT window_start, events, errors, 'truncated', CAST(truncated AS DOUBLE) / events FROM w WHERE truncated >= 5 AND events >= 10 AND CAST(truncated AS DOUBLE) / events > 0.1""")
def q_health_alerts(spark, d):
    t, n = F.col("event_type"), F.count(F.lit(1))
    w = Tables(spark, d).events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")).agg(
        n.alias("events"), F.count_if(t == "error").alias("errors"), (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / n / 100.0).alias("mean_latency"),
        F.count_if(t == "signup").alias("waiting"), (F.count_if(t == "purchase") / n).alias("hit_rate"), (F.count_if(t == "view") / n).alias("utilisation"),
        (F.count_if(t == "signup") / 60.0).alias("preemption_rate"), F.count_if(t == "click").alias("truncated"))
    return M.health_alerts(w, max_error_share=0.2, max_latency=60.0, max_waiting=3, min_hit_rate=0.1, max_utilisation=0.3, max_preemption_rate=0.05)


@register("sliding_mean", "M8", """
WITH b AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events), s AS (SELECT h AS window_start FROM b UNION SELECT h - INTERVAL 1 HOUR FROM b)
SELECT window_start, round(sum(value), 2) AS value_sum, count(*) AS events FROM s JOIN events e ON e.ts >= window_start AND e.ts < window_start + INTERVAL 2 HOUR GROUP BY 1""")
def q_sliding_mean(spark, d):
    # the sum has two decimals, a mean of doubles may lie on either side of a rounding tie
    return M.sliding_mean(Tables(spark, d).events).select("window_start", F.round(F.col("mean_value") * F.col("events"), 2).alias("value_sum"), "events")
