"""The named queries: each reads the given tables whole and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.features import mean_or_zero, port_count, std_or_zero, with_features
from flowloom.functions.packets import ACK, SYN, SYN_OR_ACK, any_flag, ipv4_only, with_flow_key, with_tcp_fields
from flowloom.functions.text import explanation, query_string
from flowloom.operators import keys, schema_check, tables
from flowloom.operators.connections import connection_counters
from flowloom.operators.explain import explain_anomalies, prompts
from flowloom.operators.flows import (
    BIDIRECTIONAL,
    default_slice_us,
    distinct_sources,
    flag_histogram,
    flow_totals,
    native_sessions,
    packet_flows,
)
from flowloom.operators.index import (
    append_to_index,
    build_index,
    load_index,
    pruned_search,
    recall_by_probes,
    unindexable,
)
from flowloom.operators.near import near_duplicates
from flowloom.operators.records import dead_letters, screen_records, validate_and_fill, with_nonfinite_flags
from flowloom.operators.retrieval import (
    class_centroids,
    encode_corpus,
    fit_corpus_encoder,
    neighbour_vote,
    normalised,
    top_k,
    with_documents,
)
from flowloom.operators.scaling import Scaler, drift_report, fit_scaler, scale
from flowloom.operators.scoring import (
    BatchScorer,
    PipelineScorer,
    anomalies,
    argmax,
    decide,
    display_line,
    first_anomalies,
    label_counts,
    label_of,
)
from flowloom.operators.trees import Tree, TreeScorer
from flowloom.plans.flows import EVENT_GAP_US, FLOW_COLUMNS, event_packets, flow_features, table
from flowloom.plans.replay import CLOSING_SRC, add_closing_packets, stage_in_time_order
from flowloom.plans.scoring import (
    PREFIX,
    demo_scorer,
    fit_and_label,
    label_rows,
    record_scorer,
    with_scaled,
)
from flowloom.schemas import FEATURES, FLOW_KEY, LABELS, quoted
from flowloom.session import broadcast_if_small, materialise, work_path
from flowloom.sources.packets import epoch_us, stream_packets
from flowloom.sources.records import (
    feature_line,
    lines_from_events,
    bad_corpus_lines,
    corpus_lines,
    read_corpus,
    read_lines,
    write_corpus,
    write_feature_lines,
)
from flowloom.sources.results import (
    append_results,
    append_scaled,
    load_table,
    read_results_csv,
    result_rows,
    save_table,
    stored_rows,
    write_anomalies,
    write_results_csv,
)
from flowloom.streaming.flows import SESSION_SETTINGS, flows_stream, stream_sessions
from flowloom.streaming.folding import folded_flows_stream
from flowloom.streaming.late import correct_flows, corrected, split_late
from flowloom.streaming.retry import drain, score_with_retries
from flowloom.streaming.scoring import (
    append_stream,
    first_anomalies_stream,
    label_counts_stream,
    score_stream,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER = ["first_us", "flow_id"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURE_COLUMNS = [quoted(f) for f in FEATURES]


def query(run: Query) -> Query:
    """Register a query; a trailing underscore keeps its name apart from an operator's."""
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles to six places, so that engines which sum in another order agree.

    Half microseconds are frequent (the deviation of two gaps is half their difference);
    the nudge keeps such ties on one side.
    """
    return df.selectExpr(*[_rounded(name, kind) for name, kind in df.dtypes])


def _rounded(name: str, kind: str) -> str:
    return f"round({quoted(name)} + 1e-9D, 6) AS {quoted(name)}" if kind == "double" else quoted(name)


# --- packets and flows -------------------------------------------------------


@query
def packet_ipv4_filter(spark, sf):
    return ipv4_only(event_packets(spark, sf)).select("pkt_id", "src", "dst", "proto", "pkt_len")


@query
def flow_key(spark, sf):
    packets = with_tcp_fields(with_flow_key(event_packets(spark, sf)))
    return packets.select(
        "pkt_id", *FLOW_KEY, "payload_len", "tcp_window", "tcp_seq", "tcp_flags", "ttl"
    )


@query
def packet_direction(spark, sf):
    flags = F.col("tcp_flags")
    return packet_flows(event_packets(spark, sf), EVENT_GAP_US, BIDIRECTIONAL).select(
        "pkt_id",
        "flow_id",
        "dir",
        any_flag(flags, SYN).alias("syn"),
        any_flag(flags, SYN_OR_ACK).alias("syn_or_ack"),
        any_flag(flags, ACK).alias("ack"),
    )


@query
def flow_sessions(spark, sf):
    return flow_totals(event_packets(spark, sf), EVENT_GAP_US).select(
        "flow_id", *FLOW_KEY, "first_us", "last_us", "pkts"
    )


@query
def flow_sessions_native(spark, sf):
    return native_sessions(event_packets(spark, sf), EVENT_GAP_US)


@query
def flow_totals_(spark, sf):
    return flow_totals(event_packets(spark, sf), EVENT_GAP_US, BIDIRECTIONAL).select(
        "flow_id", "first_us", "last_us", "pkts", "sbytes", "dbytes"
    )


@query
def flow_lists(spark, sf):
    return packet_flows(event_packets(spark, sf), EVENT_GAP_US, BIDIRECTIONAL).select(
        "flow_id", "pos", "dir", "dir_pos", "ts_us", "ttl", "payload_len", "tcp_window", "tcp_seq"
    )


@query
def flow_flag_histogram(spark, sf):
    return flag_histogram(event_packets(spark, sf), EVENT_GAP_US)


@query
def flow_interarrival(spark, sf):
    flows = flow_totals(event_packets(spark, sf), EVENT_GAP_US)
    deviation = std_or_zero("s_gap_n", "s_gap_sum", "s_gap_sq")
    return rounded(
        flows.selectExpr(
            "flow_id",
            f"{mean_or_zero('s_gap_sum', 's_gap_n')} / 1e6D AS mean_gap_s",
            f"{deviation} / 1e6D AS std_gap_s",
        )
    )


@query
def packet_gaps(spark, sf):
    return packet_flows(event_packets(spark, sf), EVENT_GAP_US, BIDIRECTIONAL).select(
        "pkt_id", "flow_id", "gap_us"
    )


@query
def flow_handshake(spark, sf):
    flows = flow_features(event_packets(spark, sf), mode=BIDIRECTIONAL)
    return rounded(flows.select("flow_id", "tcprtt", "synack"))


@query
def flow_ports(spark, sf):
    flows = flow_totals(event_packets(spark, sf), EVENT_GAP_US)
    return flows.selectExpr("flow_id", f"CAST({port_count('sport', 'dport')} AS BIGINT) AS ports")


@query
def flow_features_(spark, sf):
    return rounded(flow_features(event_packets(spark, sf)))


@query
def flow_features_bidirectional(spark, sf):
    return rounded(flow_features(event_packets(spark, sf), mode=BIDIRECTIONAL))


@query
def distinct_sources_window(spark, sf):
    return distinct_sources(event_packets(spark, sf), EVENT_GAP_US)


@query
def feature_duplicates(spark, sf):
    features = rounded(flow_features(event_packets(spark, sf)))
    return keys.duplicate_keys(features, FEATURE_COLUMNS)


@query
def near_duplicate_flows(spark, sf):
    """Flows that chains of flows connect, each step at most 0.02 deviations wide in every feature."""
    features = materialise(flow_features(event_packets(spark, sf)))
    scaled = scale(features, fit_scaler(features, FEATURES))
    return near_duplicates(scaled, "flow_id", FEATURES, 0.02)


@query
def connection_counters_(spark, sf):
    return connection_counters(flow_totals(event_packets(spark, sf), EVENT_GAP_US))


# --- records -----------------------------------------------------------------


def _screened(spark, sf):
    return screen_records(lines_from_events(table(spark, sf, "events")))


@query
def record_parse(spark, sf):
    return _screened(spark, sf).select(
        "row_id", F.col("reason").isNull().alias("accepted"), F.size("keys").alias("names")
    )


@query
def record_count_filter(spark, sf):
    return _screened(spark, sf).where(F.col("reason").isNull()).select("row_id")


@query
def record_dead_letter(spark, sf):
    return dead_letters(_screened(spark, sf)).select("row_id", "reason")


@query
def validate_fill(spark, sf):
    filled = with_nonfinite_flags(validate_and_fill(_screened(spark, sf), ["row_id"]), FEATURES)
    finite = [
        F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
        for name, c in ((f, F.col(quoted(f))) for f in FEATURES)
    ]
    return filled.select("row_id", *finite, "has_nan", "has_inf")


def _ratios(spark, sf):
    """Line items with a ratio that is NaN or infinite where the discount is 0."""
    ratio = F.when(
        F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))
    ).otherwise(F.try_divide("l_tax", "l_discount"))
    return table(spark, sf, "lineitem").withColumn("ratio", ratio)


@query
def nonfinite_check(spark, sf):
    return with_nonfinite_flags(_ratios(spark, sf), ["l_quantity", "ratio"]).select(
        "l_orderkey", "l_linenumber", "has_nan", "has_inf"
    )


@query
def schema_name_diff(spark, sf):
    screened = _screened(spark, sf)
    return schema_check.name_differences(
        schema_check.expected_names(screened), schema_check.observed_names(screened)
    )


@query
def schema_order_diff(spark, sf):
    screened = _screened(spark, sf)
    return schema_check.order_differences(
        schema_check.expected_names(screened), schema_check.observed_names(screened)
    )


@query
def jsonl_roundtrip(spark, sf):
    path = work_path(spark, "features-jsonl")
    write_feature_lines(flow_features(event_packets(spark, sf)), path)
    return rounded(validate_and_fill(screen_records(read_lines(spark, path))))


# --- scaling and scoring -----------------------------------------------------


@query
def scaler_fit(spark, sf):
    return rounded(fit_scaler(table(spark, sf, "lineitem"), NUMBERS).to_frame(spark))


def _scaled_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
    saved = save_table(fit_scaler(lines, NUMBERS).to_frame(spark), work_path(spark, "scaler"))
    return scale(lines, Scaler.from_frame(load_table(spark, saved)))


@query
def scaler_apply(spark, sf):
    return rounded(_scaled_lines(spark, sf))


@query
def scaled_drift(spark, sf):
    return rounded(drift_report(_scaled_lines(spark, sf), NUMBERS, 1.5))


def _labelled(spark, sf):
    return fit_and_label(flow_features(event_packets(spark, sf)))


def _long_probs(df):
    return df.select("flow_id", F.posexplode("probs").alias("class", "prob"))


@query
def class_probabilities(spark, sf):
    return rounded(_long_probs(_labelled(spark, sf)))


@query
def class_probabilities_batch(spark, sf):
    """The same model as a user's Python model, loaded once per task."""
    stored = materialise(flow_features(event_packets(spark, sf)))
    rule = demo_scorer("")

    def load():
        return np.array(rule.weights), np.array(rule.biases)

    def predict(model, rows):
        margins = rows @ model[0].T + model[1]
        exps = np.exp(margins - margins.max(axis=1, keepdims=True))
        return exps / exps.sum(axis=1, keepdims=True)

    scaled = scale(stored, fit_scaler(stored, FEATURES)).drop("score_status")
    return rounded(_long_probs(BatchScorer(load, predict)(scaled)))


@query
def class_probabilities_mllib(spark, sf):
    """A multinomial model of feature masses, trained on the labelled flows and applied to them."""
    labelled = materialise(_labelled(spark, sf).withColumn("best", label_of(argmax(F.col("probs")))))
    renamed = labelled.select("flow_id", "best", *[F.col(quoted(f)).cast("double").alias(f.replace(" ", "_")) for f in FEATURES])
    model = Pipeline(
        stages=[
            StringIndexer(inputCol="best", outputCol="class", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=[f.replace(" ", "_") for f in FEATURES], outputCol="inputs"),
            NaiveBayes(featuresCol="inputs", labelCol="class", smoothing=1.0, modelType="multinomial"),
        ]
    ).fit(renamed)
    return rounded(_long_probs(PipelineScorer(model)(renamed)))


@query
def nonfinite_records(spark, sf):
    """Every accepted record scored and stored, those with ``nan`` and ``inf`` among them."""
    filled = materialise(validate_and_fill(_screened(spark, sf), ["row_id"]))
    labelled = label_rows(filled, fit_scaler(filled, FEATURES))
    kept = result_rows(labelled).select("row_id", F.col("sbytes").alias("stored_sbytes"))
    text = query_string().alias("text")
    shown = labelled.select("row_id", "prediction", "label", "score_status", text)
    return rounded(shown.join(kept, "row_id"))


@query
def scaler_fit_nonfinite(spark, sf):
    """A column with NaN and infinite values, fitted on the finite ones."""
    scaler = fit_scaler(_ratios(spark, sf), ["l_quantity", "ratio"])
    out = scaler.to_frame(spark)
    left = F.element_at(F.array(*map(F.lit, scaler.left_out)), F.col("position") + 1)
    return rounded(out.withColumn("left_out", left.cast("long")))


@query
def unscaled_scores(spark, sf):
    """Without a scaler the rows are scored as they are and say so."""
    features = flow_features(event_packets(spark, sf))
    small = features.withColumns({f: F.col(quoted(f)) / F.lit(1e6) for f in FEATURES})
    return rounded(label_rows(small, None).select("flow_id", "prediction", "label", "score_status"))


def _rule_forest() -> list[Tree]:
    """Three trees of three splits per class, given by a rule; missing values go left on even trees."""
    trees = []
    for t in range(3 * len(LABELS)):
        features = [(7 * t + 5 * n) % len(FEATURES) for n in range(3)]
        thresholds = [((t * 5 + n * 3) % 9 - 4) / 8 for n in range(3)]
        leaves = [((t * 3 + n * 7) % 13 - 6) / 10 for n in range(4)]
        trees.append(
            Tree(
                t % len(LABELS),
                [*features, -1, -1, -1, -1],
                [*thresholds, 0, 0, 0, 0],
                [1, 3, 5, 0, 0, 0, 0],
                [2, 4, 6, 0, 0, 0, 0],
                [t % 2 == 0] * 7,
                [0, 0, 0, *leaves],
            )
        )
    return trees


@query
def tree_probabilities(spark, sf):
    """An ensemble of trees over scaled features, of which every flow lacks some."""
    features = materialise(flow_features(event_packets(spark, sf)))
    scaled = with_scaled(features, fit_scaler(features, FEATURES))
    lacking = {PREFIX + f: F.when((F.col("flow_id") + j) % 7 != 0, F.col(quoted(PREFIX + f))) for j, f in enumerate(FEATURES)}
    scorer = TreeScorer(_rule_forest(), [(c % 4) / 10 for c in range(len(LABELS))], PREFIX)
    return rounded(_long_probs(scorer(scaled.withColumns(lacking))))


@query
def argmax_label(spark, sf):
    best = argmax(F.col("probs"))
    return _labelled(spark, sf).select("flow_id", best.alias("class"), label_of(best).alias("best_label"))


@query
def decision_threshold(spark, sf):
    return rounded(_labelled(spark, sf).select("flow_id", "prediction", "label", "score_status"))


@query
def score_error_fallback(spark, sf):
    """Every fifth flow loses its probabilities, as if its scoring had failed."""
    failed = F.when(F.col("flow_id") % 5 != 0, F.col("probs")).alias("probs")
    labelled = _labelled(spark, sf).select("flow_id", failed)
    return rounded(decide(labelled).select("flow_id", "prediction", "label", "score_status"))


@query
def prediction_lines(spark, sf):
    return display_line(_labelled(spark, sf), ["flow_id"])


@query
def anomalies_(spark, sf):
    return rounded(anomalies(_labelled(spark, sf)).select("flow_id", "label", "prediction"))


@query
def anomalies_table(spark, sf):
    path = work_path(spark, "anomalies")
    write_anomalies(_labelled(spark, sf).select("flow_id", "prediction", "label"), path)
    return rounded(spark.read.parquet(path).select("flow_id", "label", "prediction"))


@query
def first_n_anomalies(spark, sf):
    first = first_anomalies(_labelled(spark, sf), ORDER)
    return rounded(first.select("flow_id", "first_us", "label", "prediction"))


@query
def label_counts_(spark, sf):
    return label_counts(_labelled(spark, sf))


# --- stored results ----------------------------------------------------------


def _stored(features):
    return stored_rows(features.withColumnRenamed("flow_id", "row_id"))


def _predictions(labelled):
    text = F.when(F.col("label") == "dos", F.concat(F.lit('see\n"similar", flows: '), F.col("label")))
    return labelled.select(
        F.col("flow_id").alias("row_id"), "prediction", "label", text.alias("rag_output")
    )


@query
def result_append(spark, sf):
    path = work_path(spark, "results")
    rows = _stored(flow_features(event_packets(spark, sf)))
    append_results(rows.where(F.col("dur") < 60), path)
    append_results(rows.where(F.col("dur") >= 60), path)
    return rounded(load_table(spark, path))


@query
def stored_row_count(spark, sf):
    path = work_path(spark, "results")
    append_results(_stored(flow_features(event_packets(spark, sf))), path)
    return load_table(spark, path).agg(F.count("*").alias("rows"))


@query
def results_upsert(spark, sf):
    labelled = _labelled(spark, sf)
    found = _predictions(anomalies(labelled))
    updated = keys.apply_predictions(_stored(labelled), found)
    return rounded(updated.select("row_id", "sbytes", "dur", "prediction", "label", "rag_output"))


@query
def unknown_predictions_(spark, sf):
    labelled = _labelled(spark, sf)
    shifted = _predictions(labelled).withColumn("row_id", F.col("row_id") * 2)
    return keys.unknown_predictions(_stored(labelled), shifted).select("row_id", "label")


@query
def scaled_features_table(spark, sf):
    stored = materialise(flow_features(event_packets(spark, sf)).withColumnRenamed("flow_id", "row_id"))
    path = work_path(spark, "scaled")
    append_scaled(scale(stored, fit_scaler(stored, FEATURES)), path)
    return rounded(load_table(spark, path))


@query
def results_csv_roundtrip(spark, sf):
    labelled = _labelled(spark, sf)
    path = work_path(spark, "results-csv")
    write_results_csv(keys.apply_predictions(_stored(labelled), _predictions(anomalies(labelled))), path)
    return rounded(
        read_results_csv(spark, path).select("dur", "sbytes", "Sload", "prediction", "label", "rag_output")
    )


@query
def bucket_upsert(spark, sf):
    """Predictions of anomalies go into a stored table; only their buckets are rewritten."""
    labelled = materialise(_labelled(spark, sf))
    path = work_path(spark, "bucketed-results")
    tables.write_buckets(_stored(labelled), path, "row_id")
    found = _predictions(anomalies(labelled))
    tables.rewrite_buckets(spark, path, "row_id", found, lambda old: keys.apply_predictions(old, found))
    updated = tables.read_buckets(spark, path)
    return rounded(updated.select("row_id", "sbytes", "dur", "prediction", "label", "rag_output"))


@query
def bucket_delete(spark, sf):
    """Toxic documents are deleted from a stored table, bucket by bucket."""
    path = work_path(spark, "bucketed-documents")
    tables.write_buckets(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, "doc_id")
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1)
    tables.delete_from_buckets(spark, path, "doc_id", toxic)
    return tables.read_buckets(spark, path)


# --- keys and lookups --------------------------------------------------------


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts_us", epoch_us(F.col("ts")))


@query
def row_ids(spark, sf):
    events = _events(spark, sf).select("event_id", "ts_us")
    return keys.number_rows(events, ["ts_us", "event_id"]).select("row_id", "event_id")


@query
def auto_keys(spark, sf):
    given = F.when(F.col("event_type") != "error", F.col("event_id") + 1)
    events = _events(spark, sf).select(given.alias("pk"), "event_id", "ts_us")
    return keys.fill_keys(events, "pk", ["ts_us", "event_id"]).select("pk", "event_id")


@query
def hash_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", keys.hash_key("user_id", "event_id").alias("pk"))


@query
def pk_duplicates(spark, sf):
    return keys.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query
def pk_first(spark, sf):
    events = _events(spark, sf).select("user_id", "event_type", "event_id", "ts_us")
    return keys.first_per_key(events, ["user_id", "event_type"], ["ts_us", "event_id"])


@query
def delete_by_id(spark, sf):
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1)
    documents = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return keys.delete_keys(documents, toxic, "doc_id")


@query
def point_lookup(spark, sf):
    return keys.lookup(table(spark, sf, "orders"), "o_orderkey", 7).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query
def key_lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").where(F.col("l_quantity") >= 50)
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return keys.lookup_many(orders, wanted, "l_orderkey").select("l_orderkey", "o_totalprice")


@query
def range_scan(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return keys.range_read(orders, "o_totalprice", 100000.0, 150000.0, ("o_orderkey",))


@query
def head_rows(spark, sf):
    return keys.head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query
def range_table_scan(spark, sf):
    """A key range of a table stored by ranges: only the parts that reach into it are read."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = work_path(spark, "ranges")
    tables.write_ranges(orders, path, "o_totalprice", ("o_orderkey",), parts=16)
    return tables.read_range(spark, path, "o_totalprice", 100000.0, 150000.0).select("o_orderkey", "o_totalprice")


@query
def bucketed_lookup(spark, sf):
    """Orders with a large line item, both sides stored by key, so that neither moves."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    stored = tables.write_bucketed(orders, work_path(spark, "orders"), "l_orderkey", 8)
    items = tables.write_bucketed(table(spark, sf, "lineitem"), work_path(spark, "lineitem"), "l_orderkey", 8)
    return keys.lookup_many(spark.table(stored), spark.table(items).where("l_quantity >= 50"), "l_orderkey")


# --- retrieval ---------------------------------------------------------------


def _corpus(spark, sf):
    """Documents with a label where one is known."""
    mark = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(
        F.col("quality") == 0, "poor"
    )
    return (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("doc_pos"), F.col("text").alias("input"), mark.alias("output"))
    )


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_pos"), "embedding", "label")


def _hits(spark, sf):
    """The five vectors closest to each class mean, over the whole table."""
    vectors = _vectors(spark, sf)
    return top_k(class_centroids(vectors), vectors)


@query
def l2_normalize(spark, sf):
    stretched = _vectors(spark, sf).select(
        "doc_pos", F.transform("embedding", lambda x: x.cast("double") * F.col("doc_pos")).alias("embedding")
    )
    return rounded(normalised(stretched).select("doc_pos", F.posexplode("embedding").alias("i", "x")))


@query
def topk_search(spark, sf):
    return rounded(_hits(spark, sf))


@query
def retrieve_documents(spark, sf):
    return rounded(with_documents(broadcast_if_small(_hits(spark, sf)), _corpus(spark, sf)))


@query
def neighbour_vote_(spark, sf):
    return neighbour_vote(with_documents(broadcast_if_small(_hits(spark, sf)), _corpus(spark, sf)))


@query
def corpus_roundtrip(spark, sf):
    path = work_path(spark, "corpus-jsonl")
    write_corpus(_corpus(spark, sf), path)
    return read_corpus(spark, path)


@query
def corpus_index(spark, sf):
    """Every document with its vector, built, stored and loaded again."""
    corpus = _corpus(spark, sf)
    path = work_path(spark, "corpus-index")
    save_table(encode_corpus(corpus, fit_corpus_encoder(corpus)), path)
    return load_table(spark, path).select("doc_pos", F.size("embedding").alias("dim"), "input", "output")


@query
def corpus_vectors(spark, sf):
    corpus = _corpus(spark, sf)
    encoded = encode_corpus(corpus, fit_corpus_encoder(corpus))
    return rounded(encoded.select("doc_pos", "embedding").select("doc_pos", F.posexplode("embedding").alias("i", "x")).where("x != 0"))


@query
def corpus_lines_placed(spark, sf):
    """A corpus whose lines carry no position, some of them broken: good and bad lines together.

    Positions depend on the order of lines in the files, so they are checked to be 0, 1, 2, ...
    """
    path = work_path(spark, "corpus-lines")
    doc = F.to_json(F.struct(F.col("input"), F.col("output")))
    n = F.col("doc_pos")
    line = F.when(n % 7 == 3, F.concat(F.lit("{"), doc)).when(n % 7 == 5, F.lit('{"output": "no text"}')).otherwise(doc)
    _corpus(spark, sf).where("input IS NOT NULL").select(line.alias("value")).write.text(path)
    good = read_corpus(spark, path).select("doc_pos", "input", "output")
    rank = good.agg(F.count_distinct("doc_pos").alias("places"), F.count("*").alias("rows"))
    bad = bad_corpus_lines(spark, path).groupBy("reason").agg(F.count("*").alias("rows"))
    good = rank.select(F.when(F.col("places") == F.col("rows"), "placed").alias("reason"), "rows")
    return bad.union(good)


@query
def corpus_positions(spark, sf):
    """Lines with and without positions, some given twice, some broken: where each one ends up."""
    path = work_path(spark, "corpus-lines")
    n = F.col("doc_pos")
    given = F.when(n % 10 == 0, F.floor(n / 10)).when(n % 10 == 1, F.floor(n / 20))
    doc = F.to_json(F.struct(given.alias("doc_pos"), F.concat(F.lit("text "), n.cast("string")).alias("input")))
    line = F.when(n % 7 == 3, F.concat(F.lit("{"), doc)).otherwise(doc)
    _corpus(spark, sf).orderBy("doc_pos").select(line.alias("value")).write.text(path)  # files in this order
    return corpus_lines(spark, path).select(
        F.when(F.col("reason").isNull(), F.col("doc_pos")).alias("doc_pos"), F.regexp_extract("line", r"text (\d+)", 1).alias("text"), "reason"
    )


@query
def search_all_vectors(spark, sf):
    """Every vector searched for its five nearest others."""
    vectors = _vectors(spark, sf)
    queries = vectors.select(F.col("doc_pos").alias("query_id"), "embedding")
    return rounded(top_k(queries, vectors, skip_self=True))


def _index(spark, sf):
    """All vectors indexed: three in four at once, the others appended to the stored index."""
    vectors = _vectors(spark, sf).select("doc_pos", "embedding")
    path = work_path(spark, "index")
    build_index(vectors.where("doc_pos % 4 <> 3"), path)
    return append_to_index(load_index(spark, path), vectors.where("doc_pos % 4 = 3"))


def _vector_queries(spark, sf):
    return _vectors(spark, sf).select(F.col("doc_pos").alias("query_id"), "embedding")


@query
def pruned_search_(spark, sf):
    """Every vector's five nearest others, from the stored index, without reading every list for each."""
    return rounded(pruned_search(_vector_queries(spark, sf), _index(spark, sf), skip_self=True))


@query
def index_recall(spark, sf):
    """Whether probing searches find enough of the exact five nearest: 0.95 with the index's own number of probes, all with all."""
    index = _index(spark, sf)
    lists = len(index.size)
    found = recall_by_probes(_vector_queries(spark, sf), index, sorted({index.probes, lists}), skip_self=True)
    reach = found.select("wanted", F.explode(F.array(
        F.struct(F.lit("default").alias("search"), F.lit(index.probes).alias("n"), F.lit(0.95).alias("least")),
        F.struct(F.lit("all lists").alias("search"), F.lit(lists).alias("n"), F.lit(1.0).alias("least")),
    )).alias("s"), "probes", "recall")
    return reach.where("probes = s.n").select("s.search", "wanted", (F.col("recall") >= F.col("s.least")).alias("enough"))


@query
def index_left_out(spark, sf):
    """Vectors that an index cannot hold: every fifth one here is cut short, emptied or made infinite."""
    n, v = F.col("doc_pos"), F.col("embedding").cast("array<double>")
    spoilt = (
        F.when(n % 15 == 0, F.slice(v, 1, 3))
        .when(n % 15 == 5, F.lit(None).cast("array<double>"))
        .when(n % 15 == 10, F.transform(v, lambda x: x * float("inf")))
        .otherwise(v)
    )
    vectors = _vectors(spark, sf).select("doc_pos", spoilt.alias("embedding"))
    index = build_index(vectors, work_path(spark, "index"))
    held = index.lists(spark).agg(F.lit("held").alias("reason"), F.count("*").alias("rows"))
    return unindexable(vectors, index.centres.shape[1]).groupBy("reason").agg(F.count("*").alias("rows")).union(held)


# --- explanations ------------------------------------------------------------


@query
def query_string_(spark, sf):
    return rounded(flow_features(event_packets(spark, sf))).select("flow_id", query_string().alias("text"))


@query
def prompt_text_(spark, sf):
    """Concise prompts for the class means over the document corpus."""
    documents = with_documents(broadcast_if_small(_hits(spark, sf)), _corpus(spark, sf))
    asked = class_centroids(_vectors(spark, sf)).select(
        "query_id", F.concat(F.lit("class "), F.col("query_id").cast("string")).alias("input")
    )
    return prompts(asked, documents, detailed=False)


@query
def explanation_status(spark, sf):
    documents = table(spark, sf, "documents")
    n = F.col("doc_id")
    text = F.when(n % 7 == 0, " \n ").otherwise(F.col("text"))
    return documents.select("doc_id", explanation(n % 5, n % 3, text, n % 11 == 0).alias("rag_output"))


def _explainable(spark, sf):
    """Labelled flows, stored; features are rounded for the texts, scaled ones are not."""
    labelled, shown = _labelled(spark, sf), {"flow_id", "first_us", "label", "prediction", *FEATURES}
    texts = [_rounded(name, kind) for name, kind in labelled.dtypes if name in shown]
    return materialise(labelled.selectExpr(*texts, *[quoted(PREFIX + f) for f in FEATURES]))


@query
def explained_results(spark, sf):
    """The whole path: anomaly, query string, its vector, corpus documents, generated text, stored row."""
    labelled = _explainable(spark, sf)
    corpus = _corpus(spark, sf)
    encoder = fit_corpus_encoder(corpus)
    encoded = materialise(encode_corpus(corpus, encoder))

    def write(_, prompt: str) -> str:
        """Fails for some prompts, stays silent for others."""
        if len(prompt) % 4 == 0:
            raise RuntimeError("no answer")
        return prompt + (" \n" if len(prompt) % 4 == 1 else f"\n answer of {len(prompt)} characters ")

    found = explain_anomalies(
        labelled, n=12, corpus=encoded, encoder=encoder, generator=(lambda: None, write), detailed=False
    )
    explained = labelled.join(found.select(F.col("query_id").alias("flow_id"), "rag_output"), "flow_id")
    predictions = explained.select(F.col("flow_id").alias("row_id"), "prediction", "label", "rag_output")
    updated = keys.apply_predictions(_stored(labelled), predictions)
    return rounded(updated.select("row_id", "sbytes", "prediction", "label", "rag_output"))


@query
def explain_anomaly(spark, sf):
    labelled = _explainable(spark, sf)
    return explain_anomalies(labelled, space="scaled").select(
        "query_id", "label", "documents", "neighbours", "suggested", "votes", "leading", "prompt", "rag_output"
    )


# --- streams -----------------------------------------------------------------


def _packet_stream(spark, sf):
    """Event packets as a file stream in time order, closed by far later packets."""
    packets = event_packets(spark, sf)
    path = work_path(spark, "packets")
    width = stage_in_time_order(packets, path, width=default_slice_us(EVENT_GAP_US))
    add_closing_packets(packets, path)
    return stream_packets(spark, path, 16), f"{width} microseconds"


def _collect(spark, stream):
    out = work_path(spark, "stream-out")
    append_stream(stream, out, work_path(spark, "stream-checkpoint"), conf=SESSION_SETTINGS).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_flows(spark, sf):
    packets, delay = _packet_stream(spark, sf)
    done = _collect(spark, stream_sessions(packets, EVENT_GAP_US, delay))
    return done.where(F.col("src") != CLOSING_SRC)


def _late_packets(spark, sf):
    """Packets replayed in time order, every seventh of the first half only at the end: what was late, the
    flows found without it, and the packets that these are made of."""
    packets = event_packets(spark, sf)
    raw, accepted, late = (work_path(spark, name) for name in ("raw", "accepted", "late"))
    middle = packets.stat.approxQuantile("ts_us", [0.5], 0.01)[0]
    withheld = (F.col("pkt_id") % 7 == 3) & (F.col("ts_us") < F.lit(int(middle)))
    width = stage_in_time_order(packets.where(~withheld), raw, width=default_slice_us(EVENT_GAP_US))
    packets.where(withheld).coalesce(4).write.mode("append").parquet(raw)
    split_late(
        stream_packets(spark, raw, 8), accepted, late, work_path(spark, "watermark"), work_path(spark, "checkpoint"), width
    ).awaitTermination()
    kept = spark.read.schema(packets.schema).option("recursiveFileLookup", True).parquet(accepted)
    add_closing_packets(packets, f"{accepted}/batch_id=closing")
    out = work_path(spark, "flows")
    stream = spark.readStream.schema(packets.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 16)
    flows_stream(
        stream.parquet(accepted), out, work_path(spark, "open"), work_path(spark, "checkpoint"), EVENT_GAP_US, delay=f"{width} microseconds"
    ).awaitTermination()
    behind = spark.read.schema(packets.schema).option("recursiveFileLookup", True).parquet(late)
    return behind, spark.read.parquet(out).where(F.col("src") != CLOSING_SRC), kept.where(F.col("src") != CLOSING_SRC)


@query
def stream_late_packets(spark, sf):
    """Flows of a stream with late packets, after their correction."""
    late, flows, packets = _late_packets(spark, sf)
    retracted, added = correct_flows(flows, packets, late, EVENT_GAP_US)
    return corrected(flows, retracted, added).select("flow_id", *FLOW_KEY, "first_us", "last_us", "pkts", "sbytes")


@query
def stream_retry(spark, sf):
    """Every record is scored once or dead; some need several attempts, some never succeed."""
    features = materialise(flow_features(event_packets(spark, sf)))
    scaler = fit_scaler(features, FEATURES)
    path = work_path(spark, "records")
    stage_in_time_order(features.select(F.col("flow_id").alias("row_id"), "first_us", feature_line().alias("line")), path, "first_us")
    lines = spark.readStream.schema("row_id long, line string").option("maxFilesPerTrigger", 16).parquet(path)

    def score(rows):
        """Fails for some records until their time has come."""
        scored = record_scorer(scaler)(screen_records(rows)).select("row_id", "attempt", "label", "score_status")
        broken = (F.col("row_id") % 3 == 0) & (F.col("attempt") <= F.col("row_id") % 5)
        scored = scored.withColumn("score_status", F.when(broken, "error").otherwise(F.col("score_status")))
        return scored.join(rows.select("row_id", "line"), "row_id")

    results, dead, retry = (work_path(spark, name) for name in ("scored", "dead", "retry"))
    score_with_retries(lines, score, results, dead, retry, work_path(spark, "checkpoint"), "stream").awaitTermination()
    drain(spark, score, results, dead, retry, work_path(spark, "checkpoint"))
    read = spark.read.option("recursiveFileLookup", True)
    gone = F.lit(None).cast("int").alias("attempt")
    found = read.schema("row_id long, attempt int, label string, score_status string").parquet(results)
    failed = read.schema("row_id long, line string, reason string").parquet(dead)
    return found.select("row_id", "attempt", F.lit("scored").alias("end")).union(failed.select("row_id", gone, F.col("reason").alias("end")))


@query
def stream_flow_features(spark, sf):
    packets, delay = _packet_stream(spark, sf)
    out = work_path(spark, "flows")
    flows_stream(
        packets, out, work_path(spark, "open"), work_path(spark, "checkpoint"), EVENT_GAP_US, BIDIRECTIONAL, delay
    ).awaitTermination()
    totals = spark.read.parquet(out)
    return rounded(with_features(totals.where(F.col("src") != CLOSING_SRC), FLOW_COLUMNS))


@query
def stream_folded_features(spark, sf):
    """The features of flows whose packets are folded as soon as the watermark has passed them."""
    packets, _ = _packet_stream(spark, sf)
    out, late, state = (work_path(spark, name) for name in ("flows", "late", "open"))
    width = default_slice_us(EVENT_GAP_US)  # of the ranges that are replayed in any order
    folded_flows_stream(packets, out, late, state, work_path(spark, "checkpoint"), width, EVENT_GAP_US, BIDIRECTIONAL).awaitTermination()
    totals = spark.read.parquet(out)
    return rounded(with_features(totals.where(F.col("src") != CLOSING_SRC), FLOW_COLUMNS))


def _flow_stream(spark, sf):
    """Feature records with their flow id and start, staged in time order, plus a scaler."""
    features = materialise(flow_features(event_packets(spark, sf)))
    path = work_path(spark, "records")
    stage_in_time_order(features.select("flow_id", "first_us", feature_line().alias("line")), path, "first_us")
    stream = spark.readStream.schema("flow_id long, first_us long, line string").option(
        "maxFilesPerTrigger", 16
    ).parquet(path)
    return stream, fit_scaler(features, FEATURES)


def _scored_stream(spark, sf):
    """Records of every kind, bad ones too, scored as they arrive: the paths of results and dead letters."""
    screened = _screened(spark, sf)
    scaler = fit_scaler(validate_and_fill(screened), FEATURES)
    path = work_path(spark, "lines")
    lines = lines_from_events(table(spark, sf, "events"))
    stage_in_time_order(lines, path, "row_id")
    stream = spark.readStream.schema("row_id long, line string").option("maxFilesPerTrigger", 16).parquet(path)
    results, dead = work_path(spark, "scored"), work_path(spark, "dead")
    score_stream(stream, record_scorer(scaler), results, dead, work_path(spark, "checkpoint")).awaitTermination()
    return results, dead


@query
def stream_scoring(spark, sf):
    results, _ = _scored_stream(spark, sf)
    scored = spark.read.parquet(results)
    stored = result_rows(scored).select("row_id", F.col("sbytes").alias("stored_sbytes"))
    shown = scored.select("row_id", "prediction", "label", "score_status", query_string().alias("text"))
    return rounded(shown.join(stored, "row_id"))


@query
def stream_dead_letter(spark, sf):
    _, dead = _scored_stream(spark, sf)
    return spark.read.parquet(dead).select("row_id", "reason")


def _labelled_stream(spark, sf):
    """Score records inside the stream, keeping its order columns."""
    lines, scaler = _flow_stream(spark, sf)
    return record_scorer(scaler)(screen_records(lines)).select("flow_id", "first_us", "prediction", "label")


@query
def stream_first_n(spark, sf):
    path = work_path(spark, "first")
    first_anomalies_stream(
        _labelled_stream(spark, sf), ORDER, path, work_path(spark, "checkpoint")
    ).awaitTermination()
    return rounded(spark.read.parquet(path).select("flow_id", "first_us", "label", "prediction"))


@query
def stream_label_counts(spark, sf):
    path = work_path(spark, "counts")
    label_counts_stream(_labelled_stream(spark, sf), path, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path)
