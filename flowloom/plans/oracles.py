"""The named queries in plain SQL, written from the definitions rather than from the
DataFrame code: sessions by lag and running sum, deviations by ``stddev_pop``, top-k by
scoring every pair."""

from __future__ import annotations

from flowloom.functions.text import CONCISE_PROMPT, DETAILED_PROMPT
from flowloom.schemas import FEATURES, INTEGER_FEATURES, LABELS

# Rounded values read (round(x + 1e-9, 6) + 0.0): ties go up and zero has no sign, as in the queries.
GAP = 6 * 3600 * 1_000_000
N = len(FEATURES)


def q(name: str) -> str:
    return f'"{name}"'


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- packets and flows -------------------------------------------------------

PACKETS = [
    """ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us, CAST(floor(value) AS BIGINT) AS size,
    CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS k,
    CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS proto,
    '10.0.0.' || user_id AS user_host, '192.168.1.' || (user_id % 7) AS service_host,
    event_type IN ('signup', 'error') AS rev
  FROM events)""",
    """ports AS (
  SELECT *, CASE WHEN proto IN (6, 17) THEN 20000 + user_id ELSE 0 END AS user_port,
    CASE WHEN proto = 6 THEN CASE WHEN user_id % 2 = 0 THEN 80 ELSE 443 END
         WHEN proto = 17 THEN 53 ELSE 0 END AS service_port
  FROM ev)""",
    """packets AS (
  SELECT event_id AS pkt_id, ts_us, CASE WHEN event_id % 50 = 0 THEN 6 ELSE 4 END AS ip_version,
    CASE WHEN rev THEN service_host ELSE user_host END AS src,
    CASE WHEN rev THEN user_host ELSE service_host END AS dst,
    CAST(CASE WHEN rev THEN service_port ELSE user_port END AS INTEGER) AS sport,
    CAST(CASE WHEN rev THEN user_port ELSE service_port END AS INTEGER) AS dport,
    CAST(proto AS INTEGER) AS proto, 40 + size AS pkt_len,
    CASE WHEN proto = 6 THEN size * 10 ELSE 0 END AS payload_len,
    CASE WHEN proto = 6 THEN k * 256 END AS tcp_window,
    CASE WHEN proto = 6 THEN event_id * 1000 END AS tcp_seq,
    CAST(CASE WHEN proto = 6 THEN CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 24
      WHEN 'purchase' THEN 17 WHEN 'signup' THEN 18 ELSE 16 END END AS INTEGER) AS tcp_flags,
    CAST(64 - k % 4 AS INTEGER) AS ttl
  FROM ports)""",
]


def flow_ctes(bidirectional: bool = False) -> list[str]:
    """``tagged``: every IPv4 packet with its flow; ``flows``: one row per flow."""
    if bidirectional:
        key = """least(src || '|' || sport, dst || '|' || dport) || '>' ||
      greatest(src || '|' || sport, dst || '|' || dport) || '>' || proto"""
    else:
        key = "src || '|' || sport || '>' || dst || '|' || dport || '>' || proto"
    return PACKETS + [
        f"keyed AS (SELECT *, {key} AS fk FROM packets WHERE ip_version = 4)",
        """gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY fk ORDER BY ts_us, pkt_id) AS idle
  FROM keyed)""",
        f"""numbered AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > {GAP} THEN 1 ELSE 0 END)
    OVER (PARTITION BY fk ORDER BY ts_us, pkt_id) AS session_no FROM gaps)""",
        """opened AS (SELECT *, first_value(pkt_id) OVER w AS flow_id, first_value(src) OVER w AS f_src,
    first_value(dst) OVER w AS f_dst, first_value(sport) OVER w AS f_sport,
    first_value(dport) OVER w AS f_dport, row_number() OVER w AS pos
  FROM numbered WINDOW w AS (PARTITION BY fk, session_no ORDER BY ts_us, pkt_id))""",
        """directed AS (SELECT *, CASE WHEN src = f_src AND dst = f_dst THEN 's'
    WHEN src = f_dst AND dst = f_src THEN 'd' ELSE 's' END AS dir FROM opened)""",
        """tagged AS (SELECT *, row_number() OVER w AS dir_pos, ts_us - lag(ts_us) OVER w AS gap_us
  FROM directed WINDOW w AS (PARTITION BY flow_id, dir ORDER BY ts_us, pkt_id))""",
        """flows AS (SELECT flow_id, any_value(f_src) AS src, any_value(f_sport) AS sport,
    any_value(f_dst) AS dst, any_value(f_dport) AS dport, any_value(proto) AS proto,
    min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS pkts,
    CAST(coalesce(sum(pkt_len) FILTER (dir = 's'), 0) AS BIGINT) AS sbytes,
    CAST(coalesce(sum(pkt_len) FILTER (dir = 'd'), 0) AS BIGINT) AS dbytes,
    greatest(0.001, (max(ts_us) - min(ts_us)) / 1e6) AS dur,
    coalesce(avg(tcp_window) FILTER (dir = 's'), 0) AS win,
    coalesce(min_by(tcp_seq, pos) FILTER (dir = 's' AND tcp_seq IS NOT NULL), 0) AS seq,
    avg(least(payload_len, 1500)) AS payload,
    coalesce(avg(gap_us / 1e6) FILTER (dir = 's'), 0) AS s_gap,
    coalesce(stddev_pop(gap_us / 1e6) FILTER (dir = 's'), 0) AS s_jit,
    coalesce(stddev_pop(gap_us / 1e6) FILTER (dir = 'd'), 0) AS d_jit,
    min(ts_us) FILTER (dir = 's' AND tcp_flags & 2 <> 0) AS syn_us,
    min(ts_us) FILTER (dir = 'd' AND tcp_flags & 18 <> 0) AS synack_us,
    min(ts_us) FILTER (dir = 'd' AND tcp_flags & 16 <> 0) AS ack_us,
    count(tcp_seq) FILTER (dir = 'd') AS d_seqs
  FROM tagged GROUP BY flow_id)""",
        """features AS (SELECT flow_id, src, sport, dst, dport, proto, first_us,
    dur, sbytes, dbytes, ln(1 + sbytes / dur) AS "Sload", CAST(floor(win) AS BIGINT) AS swin,
    CAST(seq AS BIGINT) AS stcpb, ln(1 + payload) AS smeansz, s_jit AS "Sjit", d_jit AS "Djit",
    ln(1 + dur) AS "Stime", ln(1 + greatest(s_gap, 0.0001)) AS "Sintpkt",
    greatest(0.0, coalesce((ack_us - syn_us) / 1e6, 0.0)) AS tcprtt,
    greatest(0.0, coalesce((synack_us - syn_us) / 1e6, 0.0)) AS synack,
    CAST((sport <> 0)::INT + (dport <> 0 AND dport <> sport)::INT AS BIGINT) AS ct_srv_src,
    CAST(greatest(1, d_seqs) AS BIGINT) AS ct_srv_dst, CAST(1 AS BIGINT) AS ct_dst_ltm,
    CAST(1 AS BIGINT) AS "ct_src_ ltm", CAST(1 AS BIGINT) AS ct_dst_src_ltm
  FROM flows)""",
    ]


def rounded_features(alias: str = "") -> str:
    return ", ".join(
        f"{alias}{q(f)}" if f in INTEGER_FEATURES else f"(round({alias}{q(f)} + 1e-9, 6) + 0.0) AS {q(f)}"
        for f in FEATURES
    )


OBSERVED = flow_ctes()
BOTH = flow_ctes(True)
FLOW_COLUMNS = "flow_id, src, sport, dst, dport, proto, first_us"

ORACLES: dict[str, str] = {
    "packet_ipv4_filter": with_ctes(
        PACKETS, "SELECT pkt_id, src, dst, proto, pkt_len FROM packets WHERE ip_version = 4"
    ),
    "flow_key": with_ctes(
        PACKETS,
        "SELECT pkt_id, src, sport, dst, dport, proto, payload_len, tcp_window, tcp_seq, tcp_flags, ttl FROM packets",
    ),
    "packet_direction": with_ctes(
        BOTH,
        "SELECT pkt_id, flow_id, dir, tcp_flags & 2 <> 0 AS syn, tcp_flags & 18 <> 0 AS syn_or_ack, "
        "tcp_flags & 16 <> 0 AS ack FROM tagged",
    ),
    "flow_sessions": with_ctes(
        OBSERVED, "SELECT flow_id, src, sport, dst, dport, proto, first_us, last_us, pkts FROM flows"
    ),
    "flow_sessions_native": with_ctes(
        OBSERVED,
        "SELECT src, sport, dst, dport, proto, first_us, last_us, pkts, sbytes AS bytes FROM flows",
    ),
    "flow_totals": with_ctes(BOTH, "SELECT flow_id, first_us, last_us, pkts, sbytes, dbytes FROM flows"),
    "flow_lists": with_ctes(
        BOTH,
        "SELECT flow_id, pos, dir, dir_pos, ts_us, ttl, payload_len, tcp_window, tcp_seq FROM tagged",
    ),
    "flow_flag_histogram": with_ctes(
        OBSERVED,
        "SELECT flow_id, tcp_flags, count(*) AS packets FROM tagged WHERE tcp_flags IS NOT NULL GROUP BY ALL",
    ),
    "flow_interarrival": with_ctes(
        OBSERVED, "SELECT flow_id, (round(s_gap + 1e-9, 6) + 0.0) AS mean_gap_s, (round(s_jit + 1e-9, 6) + 0.0) AS std_gap_s FROM flows"
    ),
    "packet_gaps": with_ctes(BOTH, "SELECT pkt_id, flow_id, gap_us FROM tagged"),
    "flow_handshake": with_ctes(
        BOTH, "SELECT flow_id, (round(tcprtt + 1e-9, 6) + 0.0) AS tcprtt, (round(synack + 1e-9, 6) + 0.0) AS synack FROM features"
    ),
    "flow_ports": with_ctes(
        OBSERVED
        + [
            """used AS (SELECT flow_id, sport AS port FROM tagged WHERE sport <> 0
  UNION SELECT flow_id, dport FROM tagged WHERE dport <> 0)"""
        ],
        "SELECT f.flow_id, count(u.port) AS ports FROM flows f LEFT JOIN used u USING (flow_id) GROUP BY f.flow_id",
    ),
    "flow_features": with_ctes(OBSERVED, f"SELECT {FLOW_COLUMNS}, {rounded_features()} FROM features"),
    "flow_features_bidirectional": with_ctes(
        BOTH, f"SELECT {FLOW_COLUMNS}, {rounded_features()} FROM features"
    ),
    "feature_duplicates": with_ctes(
        OBSERVED + [f"r AS (SELECT {rounded_features()} FROM features)"],
        "SELECT *, count(*) AS rows FROM r GROUP BY ALL HAVING count(*) > 1",
    ),
    "jsonl_roundtrip": with_ctes(
        OBSERVED,
        "SELECT "
        + ", ".join(f"(round(CAST({q(f)} AS DOUBLE) + 1e-9, 6) + 0.0) AS {q(f)}" for f in FEATURES)
        + " FROM features",
    ),
}
ORACLES["stream_flows"] = ORACLES["flow_sessions_native"]
ORACLES["stream_flow_features"] = ORACLES["flow_features_bidirectional"]

# --- records: what each kind of line must turn into ---------------------------

KIND = "event_id % 13"
REASON = f"""CASE {KIND} WHEN 1 THEN 'feature_count' WHEN 2 THEN 'feature_count' WHEN 8 THEN 'malformed'
  WHEN 9 THEN 'not_object' WHEN 10 THEN 'duplicate_key' WHEN 12 THEN 'malformed' END"""
RECORDS = [f"r AS (SELECT event_id AS row_id, user_id, {KIND} AS kind, {REASON} AS reason FROM events WHERE {KIND} <> 11)"]


def _filled(j: int) -> str:
    plain = f"CAST((row_id * 7 + user_id * {j}) % 1000 AS DOUBLE)"
    odd = {
        0: "WHEN 4 THEN 1.5 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN NULL",
        1: "WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN NULL",
        2: "WHEN 5 THEN 0",
        3: "WHEN 5 THEN 0",
        N - 1: "WHEN 3 THEN 0",
    }.get(j)
    return f"CASE kind {odd} ELSE {plain} END" if odd else plain


# One name per record kind takes the place of the last one.
RENAMED = ", ".join(f"({k}, '{name}')" for k, name in ((3, "other"), (10, "dur")))

ORACLES |= {
    "record_parse": with_ctes(
        RECORDS,
        """SELECT row_id, reason IS NULL AS accepted,
  CAST(CASE kind WHEN 1 THEN 17 WHEN 2 THEN 19 WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 12 THEN NULL ELSE 18 END AS INTEGER) AS names
FROM r""",
    ),
    "record_count_filter": with_ctes(RECORDS, "SELECT row_id FROM r WHERE reason IS NULL"),
    "record_dead_letter": with_ctes(
        [f"r AS (SELECT event_id AS row_id, {REASON} AS reason FROM events)"],
        "SELECT row_id, reason FROM r WHERE reason IS NOT NULL",
    ),
    "validate_fill": with_ctes(
        RECORDS,
        "SELECT row_id, "
        + ", ".join(f"{_filled(j)} AS {q(f)}" for j, f in enumerate(FEATURES))
        + ", kind = 7 AS has_nan, kind = 7 AS has_inf FROM r WHERE reason IS NULL",
    ),
    "nonfinite_check": """SELECT l_orderkey, l_linenumber, l_discount = 0 AND l_tax = 0 AS has_nan,
  l_discount = 0 AND l_tax <> 0 AS has_inf FROM lineitem""",
    "schema_name_diff": with_ctes(
        RECORDS,
        """SELECT 'extra' AS side, CASE kind WHEN 2 THEN 'extra' ELSE 'other' END AS name, count(*) AS records
FROM r WHERE kind IN (2, 3) GROUP BY kind""",
    ),
    "schema_order_diff": with_ctes(
        RECORDS + [f"renamed(kind, name) AS (VALUES {RENAMED})"],
        f"""SELECT CAST({N - 1} AS INTEGER) AS position, '{FEATURES[-1]}' AS expected, name AS actual, count(*) AS records
FROM r JOIN renamed USING (kind) GROUP BY name""",
    ),
}

# --- scaling and scoring -----------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_STATS = [
    "st AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)
    + " FROM lineitem)",
    "z AS (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in NUMBERS)
    + " FROM lineitem, st)",
]

SCORED = (
    OBSERVED
    + [
        "stats AS (SELECT "
        + ", ".join(f"avg({q(f)}) AS m{j}, stddev_pop({q(f)}) AS s{j}" for j, f in enumerate(FEATURES))
        + " FROM features)",
        "scaled AS (SELECT features.*, "
        + ", ".join(
            f"({q(f)} - m{j}) / CASE WHEN s{j} = 0 THEN 1 ELSE s{j} END AS z{j}"
            for j, f in enumerate(FEATURES)
        )
        + " FROM features, stats)",
        "margins AS (SELECT *, "
        + ", ".join(
            " + ".join(f"({((c * 7 + j * 3) % 11 - 5) / 10}) * z{j}" for j in range(N))
            + f" + {(c % 4) / 10} AS g{c}"
            for c in range(len(LABELS))
        )
        + " FROM scaled)",
        "tops AS (SELECT *, greatest(" + ", ".join(f"g{c}" for c in range(len(LABELS))) + ") AS top FROM margins)",
        "exps AS (SELECT *, " + ", ".join(f"exp(g{c} - top) AS e{c}" for c in range(len(LABELS))) + " FROM tops)",
        "probs AS (SELECT *, "
        + ", ".join(
            f"e{c} / (" + " + ".join(f"e{i}" for i in range(len(LABELS))) + f") AS p{c}"
            for c in range(len(LABELS))
        )
        + " FROM exps)",
        "best AS (SELECT *, greatest("
        + ", ".join(f"p{c}" for c in range(len(LABELS)))
        + ") AS p_max, CASE greatest("
        + ", ".join(f"p{c}" for c in range(len(LABELS)))
        + ") "
        + " ".join(f"WHEN p{c} THEN {c}" for c in range(len(LABELS)))
        + " END AS class FROM probs)",
        "named(class, class_label) AS (VALUES "
        + ", ".join(f"({c}, '{name}')" for c, name in enumerate(LABELS))
        + ")",
        """labelled AS (SELECT best.*, class_label, CASE WHEN p7 >= 0.15 THEN 'normal' ELSE class_label END AS label,
    CASE WHEN p7 >= 0.15 THEN p7 ELSE p_max END AS prediction
  FROM best JOIN named USING (class))""",
    ]
)
PROBS = with_ctes(
    SCORED,
    " UNION ALL ".join(
        f"SELECT flow_id, CAST({c} AS INTEGER) AS class, (round(p{c} + 1e-9, 6) + 0.0) AS prob FROM labelled"
        for c in range(len(LABELS))
    ),
)
DECIDED = with_ctes(
    SCORED, "SELECT flow_id, (round(prediction + 1e-9, 6) + 0.0) AS prediction, label, 'ok' AS score_status FROM labelled"
)
ANOMALIES = with_ctes(
    SCORED, "SELECT flow_id, label, (round(prediction + 1e-9, 6) + 0.0) AS prediction FROM labelled WHERE label <> 'normal'"
)
FIRST = with_ctes(
    SCORED,
    """SELECT flow_id, first_us, label, (round(prediction + 1e-9, 6) + 0.0) AS prediction FROM labelled
WHERE label <> 'normal' ORDER BY first_us, flow_id LIMIT 3""",
)
COUNTS = with_ctes(SCORED, "SELECT label, count(*) AS rows FROM labelled GROUP BY label")

ANOMALY_TEXT = "CASE WHEN label = 'dos' THEN 'see' || chr(10) || '\"similar\", flows: ' || label END"

ORACLES |= {
    "scaler_fit": with_ctes(
        LINE_STATS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({i} AS INTEGER) AS position, (round(m_{c} + 1e-9, 6) + 0.0) AS mean, "
            f"(round(s_{c} + 1e-9, 6) + 0.0) AS scale FROM st"
            for i, c in enumerate(NUMBERS)
        ),
    ),
    "scaler_fit_nonfinite": with_ctes(
        ["""v AS (SELECT l_quantity, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem)"""],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, CAST({i} AS INTEGER) AS position, (round(avg({c}) + 1e-9, 6) + 0.0) AS mean,
  (round(stddev_pop({c}) + 1e-9, 6) + 0.0) AS scale, count(*) - count({c}) AS left_out FROM v"""
            for i, c in enumerate(["l_quantity", "ratio"])
        ),
    ),
    "scaler_apply": with_ctes(
        LINE_STATS,
        "SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"(round({c} + 1e-9, 6) + 0.0) AS {c}" for c in NUMBERS)
        + ", 'ok' AS score_status FROM z",
    ),
    "scaled_drift": with_ctes(
        LINE_STATS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, (round(avg(CASE WHEN abs({c}) > 1.5 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) + 0.0) AS share FROM z"
            for c in NUMBERS
        ),
    ),
    "class_probabilities": PROBS,
    "class_probabilities_batch": PROBS,
    "argmax_label": with_ctes(
        SCORED, "SELECT flow_id, CAST(class AS INTEGER) AS class, class_label AS best_label FROM labelled"
    ),
    "decision_threshold": DECIDED,
    "score_error_fallback": with_ctes(
        SCORED,
        """SELECT flow_id, CASE WHEN flow_id % 5 = 0 THEN 0.0 ELSE (round(prediction + 1e-9, 6) + 0.0) END AS prediction,
  CASE WHEN flow_id % 5 = 0 THEN 'analysis' ELSE label END AS label,
  CASE WHEN flow_id % 5 = 0 THEN 'error' ELSE 'ok' END AS score_status FROM labelled""",
    ),
    "prediction_lines": with_ctes(
        SCORED,
        "SELECT flow_id, 'Prediction: ' || upper(label) || ' (value=' || printf('%.6f', prediction) || ')' AS line FROM labelled",
    ),
    "anomalies": ANOMALIES,
    "anomalies_table": ANOMALIES,
    "first_n_anomalies": FIRST,
    "stream_first_n": FIRST,
    "label_counts": COUNTS,
    "stream_label_counts": COUNTS,
    "result_append": with_ctes(
        OBSERVED,
        f"""SELECT flow_id AS row_id, {rounded_features()}, CAST(NULL AS DOUBLE) AS prediction,
  CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS rag_output FROM features""",
    ),
    "stored_row_count": with_ctes(OBSERVED, "SELECT count(*) AS rows FROM flows"),
    "results_upsert": with_ctes(
        SCORED,
        f"""SELECT flow_id AS row_id, sbytes, (round(dur + 1e-9, 6) + 0.0) AS dur,
  CASE WHEN label <> 'normal' THEN (round(prediction + 1e-9, 6) + 0.0) END AS prediction,
  CASE WHEN label <> 'normal' THEN label END AS label, {ANOMALY_TEXT} AS rag_output FROM labelled""",
    ),
    "unknown_predictions": with_ctes(
        SCORED,
        "SELECT flow_id * 2 AS row_id, label FROM labelled WHERE flow_id * 2 NOT IN (SELECT flow_id FROM flows)",
    ),
    "scaled_features_table": with_ctes(
        SCORED,
        "SELECT flow_id AS row_id, "
        + ", ".join(f"(round(z{j} + 1e-9, 6) + 0.0) AS {q(f)}" for j, f in enumerate(FEATURES))
        + " FROM labelled",
    ),
    "results_csv_roundtrip": with_ctes(
        SCORED,
        f"""SELECT (round(dur + 1e-9, 6) + 0.0) AS dur, CAST(sbytes AS DOUBLE) AS sbytes, (round("Sload" + 1e-9, 6) + 0.0) AS "Sload",
  CASE WHEN label <> 'normal' THEN (round(prediction + 1e-9, 6) + 0.0) END AS prediction,
  CASE WHEN label <> 'normal' THEN label END AS label, {ANOMALY_TEXT} AS rag_output FROM labelled""",
    ),
}

# --- keys and lookups --------------------------------------------------------

ORACLES |= {
    "row_ids": "SELECT row_number() OVER (ORDER BY ts, event_id) AS row_id, event_id FROM events",
    "auto_keys": """WITH g AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_id + 1 END AS given FROM events)
SELECT given AS pk, event_id FROM g WHERE given IS NOT NULL UNION ALL
SELECT (SELECT max(given) FROM g) + row_number() OVER (ORDER BY ts, event_id), event_id FROM g WHERE given IS NULL""",
    "hash_keys": """SELECT event_id, sha256('{"user_id":' || user_id || ',"event_id":' || event_id || '}') AS pk FROM events""",
    "pk_duplicates": "SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1",
    "pk_first": """SELECT user_id, event_type, event_id, epoch_us(ts) AS ts_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "delete_by_id": """SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7",
    "key_lookup": """SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""",
    "range_scan": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000
ORDER BY o_totalprice, o_orderkey""",
    "head_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
}

# --- retrieval ---------------------------------------------------------------

CORPUS = [
    """corpus AS (SELECT doc_id AS doc_pos, text AS input,
    CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END AS output
  FROM documents LEFT JOIN labels USING (doc_id))"""
]
# Words to buckets, weights and unit vectors; lists keep the order of sums fixed.
DIM = 256


def encoded_ctes(name: str, source: str, key: str) -> list[str]:
    """``name``: (key, i, x) for the texts of ``source`` (key, input), weighted by ``idf``."""
    return [
        f"""{name}_words AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(input), '[^\\p{{L}}\\p{{N}}]+'),
    lambda w: w <> '')) AS w FROM {source})""",
        f"""{name}_counts AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS i, count(*) AS n
  FROM {name}_words GROUP BY ALL)""",
    ]


ENCODED = CORPUS + encoded_ctes("doc", "corpus", "doc_pos") + [
    f"""idf AS (SELECT i, ln(((SELECT count(*) FROM corpus) + 1) / (count(doc_pos) + 1)) AS v
  FROM range({DIM}) r(i) LEFT JOIN doc_counts USING (i) GROUP BY i)""",
    "weights AS (SELECT doc_pos, i, n * v AS w FROM doc_counts JOIN idf USING (i))",
    "sizes AS (SELECT doc_pos, sqrt(list_sum(list(w * w ORDER BY i))) AS len FROM weights GROUP BY doc_pos)",
    "vectors AS (SELECT doc_pos, i, w / len AS x FROM weights JOIN sizes USING (doc_pos) WHERE len > 0)",
]
HITS = [
    """coords AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings)""",
    "means AS (SELECT label, i, avg(x) AS x FROM coords GROUP BY label, i)",
    "lengths AS (SELECT label, sqrt(sum(x * x)) AS len FROM means GROUP BY label)",
    """scores AS (SELECT m.label::BIGINT AS query_id, c.vec_id AS doc_pos, sum(m.x / l.len * c.x) AS score
  FROM means m JOIN lengths l USING (label) JOIN coords c ON c.i = m.i GROUP BY ALL)""",
    """hits AS (SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_pos, (round(score + 1e-9, 6) + 0.0) AS score FROM scores
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_pos) QUALIFY row_number() OVER w <= 5)""",
]
FOUND = HITS + CORPUS + [
    """found AS (SELECT query_id, rank, doc_pos, score, input, coalesce(output, '') AS output
  FROM hits JOIN corpus USING (doc_pos))"""
]


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def prompt_sql(template: str, context: str, query: str) -> str:
    head, rest = template.split("{context}")
    middle, tail = rest.split("{query}")
    return f"{sql_text(head)} || {context} || {sql_text(middle)} || {query} || {sql_text(tail)}"


EXAMPLES = (
    "string_agg('Example ' || rank || ':' || chr(10) || 'INPUT: ' || input || chr(10) || 'LABEL: ' || output || chr(10), "
    "chr(10) ORDER BY rank)"
)
FLOW_TEXT = " || ' | ' || ".join(
    f"'{f}: ' || "
    + (f"{q(f)}::BIGINT::VARCHAR" if f in INTEGER_FEATURES else f"(round({q(f)} + 1e-9, 6) + 0.0)::DECIMAL(38,6)::VARCHAR")
    for f in FEATURES
)

ORACLES |= {
    "l2_normalize": """WITH c AS (SELECT vec_id AS doc_pos, unnest(embedding)::DOUBLE * vec_id AS x,
    generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
n AS (SELECT doc_pos, sqrt(sum(x * x)) AS len FROM c GROUP BY doc_pos)
SELECT doc_pos, CAST(i AS INTEGER) AS i, CASE WHEN len > 0 THEN (round(x / len + 1e-9, 6) + 0.0) ELSE 0.0 END AS x FROM c JOIN n USING (doc_pos)""",
    "topk_search": with_ctes(HITS, "SELECT * FROM hits"),
    "retrieve_documents": with_ctes(FOUND, "SELECT * FROM found"),
    "neighbour_vote": with_ctes(
        FOUND,
        """SELECT query_id, output AS suggested, count(*) AS votes FROM found GROUP BY query_id, output
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, output) = 1""",
    ),
    "corpus_roundtrip": with_ctes(CORPUS, "SELECT doc_pos, input, output FROM corpus"),
    "corpus_index": with_ctes(CORPUS, f"SELECT doc_pos, CAST({DIM} AS INTEGER) AS dim, input, output FROM corpus"),
    "corpus_vectors": with_ctes(
        ENCODED, "SELECT doc_pos, CAST(i AS INTEGER) AS i, (round(x + 1e-9, 6) + 0.0) AS x FROM vectors WHERE x <> 0"
    ),
    "corpus_lines_placed": with_ctes(
        CORPUS,
        """SELECT CASE doc_pos % 7 WHEN 3 THEN 'malformed' WHEN 5 THEN 'no_input' ELSE 'placed' END AS reason,
  count(*) AS rows FROM corpus WHERE input IS NOT NULL GROUP BY 1""",
    ),
    "search_all_vectors": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_pos,
    list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_pos, (round(score + 1e-9, 6) + 0.0) AS score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_pos) QUALIFY row_number() OVER w <= 5""",
    "query_string": with_ctes(OBSERVED, f"SELECT flow_id, {FLOW_TEXT} AS text FROM features"),
    "prompt_text": with_ctes(
        FOUND + [f"ctx AS (SELECT query_id, CAST(count(*) AS INTEGER) AS documents, {EXAMPLES} AS context FROM found GROUP BY query_id)"],
        "SELECT l.label::BIGINT AS query_id, coalesce(documents, 0) AS documents, "
        + prompt_sql(CONCISE_PROMPT, "context", "'class ' || query_id")
        + " AS prompt FROM lengths l LEFT JOIN ctx ON query_id = l.label",
    ),
    "explanation_status": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '[RAG ERROR]'
  WHEN doc_id % 5 = 0 THEN '[RAG] No knowledge available' WHEN doc_id % 3 = 0 THEN '[RAG] No relevant documents found'
  WHEN doc_id % 7 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '[RAG] Model returned empty output' ELSE text END AS rag_output
FROM documents""",
}

# --- explanation of the first anomalies ----------------------------------------

LENGTH = "sqrt(" + " + ".join(f"z{j} * z{j}" for j in range(N)) + ")"
EXPLAIN = SCORED + [
    f"vectors AS (SELECT *, {FLOW_TEXT} AS input, {LENGTH} AS len FROM labelled)",
    "asked AS (SELECT * FROM vectors WHERE label <> 'normal' ORDER BY first_us, flow_id LIMIT 3)",
    "pairs AS (SELECT a.flow_id AS query_id, v.flow_id AS doc_pos, v.input, v.label AS output, ("
    + " + ".join(f"(a.z{j} / a.len) * (v.z{j} / v.len)" for j in range(N))
    + ") AS score FROM asked a JOIN vectors v ON a.flow_id <> v.flow_id)",
    """found AS (SELECT *, row_number() OVER w AS rank FROM pairs
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_pos) QUALIFY row_number() OVER w <= 5)""",
    f"""ctx AS (SELECT query_id, CAST(count(*) AS INTEGER) AS documents, {EXAMPLES} AS context,
    string_agg(doc_pos, ',' ORDER BY rank) AS neighbours FROM found GROUP BY query_id)""",
    """votes AS (SELECT query_id, output AS suggested, count(*) AS votes FROM found GROUP BY query_id, output
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, output) = 1)""",
    "far AS ("
    + " UNION ALL ".join(
        f"SELECT flow_id AS query_id, '{f}' AS name, {j} AS position, round(abs(z{j}), 6) AS d FROM asked"
        for j, f in enumerate(FEATURES)
    )
    + ")",
    """lead3 AS (SELECT * FROM far
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d DESC, position) <= 3)""",
    """leads AS (SELECT query_id, string_agg(name, ',' ORDER BY d DESC, position) AS leading_names,
    string_agg(name, ', ' ORDER BY d DESC, position) AS spoken FROM lead3 GROUP BY query_id)""",
]
ORACLES["explain_anomaly"] = with_ctes(
    EXPLAIN,
    "SELECT a.flow_id AS query_id, a.label, documents, neighbours, suggested, votes, leading_names AS leading, "
    + prompt_sql(DETAILED_PROMPT, "context", "a.input")
    + """ AS prompt, 'Suggested label: ' || suggested || ' (' || votes || ' of ' || documents ||
  ' similar flows). Leading features: ' || spoken AS rag_output
FROM asked a JOIN ctx ON ctx.query_id = a.flow_id JOIN votes ON votes.query_id = a.flow_id
JOIN leads ON leads.query_id = a.flow_id""",
)

# --- the whole path, from anomaly to stored explanation ----------------------------

PATH = SCORED + ENCODED + [
    f"asked AS (SELECT *, flow_id AS query_id, {FLOW_TEXT} AS input FROM labelled WHERE label <> 'normal' ORDER BY first_us, flow_id LIMIT 12)",
    *encoded_ctes("ask", "asked", "query_id"),
    "ask_weights AS (SELECT query_id, i, n * v AS w FROM ask_counts JOIN idf USING (i))",
    "ask_sizes AS (SELECT query_id, sqrt(list_sum(list(w * w ORDER BY i))) AS len FROM ask_weights GROUP BY query_id)",
    "ask_vectors AS (SELECT query_id, i, w / len AS x FROM ask_weights JOIN ask_sizes USING (query_id))",
    f"grid AS (SELECT query_id, doc_pos, i FROM asked, corpus, range({DIM}) r(i))",
    """pairs AS (SELECT query_id, doc_pos, list_sum(list(coalesce(a.x, 0) * coalesce(d.x, 0) ORDER BY i)) AS score
  FROM grid LEFT JOIN ask_vectors a USING (query_id, i) LEFT JOIN vectors d USING (doc_pos, i) GROUP BY ALL)""",
    """found AS (SELECT query_id, doc_pos, input, coalesce(output, '') AS output, row_number() OVER w AS rank
  FROM pairs JOIN corpus USING (doc_pos)
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_pos) QUALIFY row_number() OVER w <= 5)""",
    f"ctx AS (SELECT query_id, {EXAMPLES} AS context FROM found GROUP BY query_id)",
    "prompted AS (SELECT query_id, "
    + prompt_sql(CONCISE_PROMPT, "context", "input")
    + " AS prompt FROM asked JOIN ctx USING (query_id))",
    """said AS (SELECT query_id, CASE length(prompt) % 4 WHEN 0 THEN '[RAG ERROR]' WHEN 1 THEN '[RAG] Model returned empty output'
    ELSE 'answer of ' || length(prompt) || ' characters' END AS rag_output FROM prompted)""",
]
ORACLES["explained_results"] = with_ctes(
    PATH,
    """SELECT l.flow_id AS row_id, l.sbytes, CASE WHEN query_id IS NOT NULL THEN (round(l.prediction + 1e-9, 6) + 0.0) END AS prediction,
  CASE WHEN query_id IS NOT NULL THEN l.label END AS label, rag_output
FROM labelled l LEFT JOIN said ON query_id = l.flow_id""",
)

# --- a multinomial model, in closed form -------------------------------------------

MASSES = [f"sum({q(f)}::DOUBLE) AS t{j}" for j, f in enumerate(FEATURES)]
ORACLES["class_probabilities_mllib"] = with_ctes(
    SCORED
    + [
        "per_class AS (SELECT class_label, count(*) AS n, " + ", ".join(MASSES) + " FROM labelled GROUP BY class_label)",
        "totals AS (SELECT *, row_number() OVER (ORDER BY class_label) - 1 AS c, sum(n) OVER () AS rows, count(*) OVER () AS classes, "
        + " + ".join(f"t{j}" for j in range(N))
        + " AS mass FROM per_class)",
        "raw AS (SELECT flow_id, c, ln(n + 1) - ln(rows + classes) + "
        + " + ".join(f"{q(f)} * (ln(t{j} + 1) - ln(mass + {N}))" for j, f in enumerate(FEATURES))
        + " AS s FROM labelled, totals)",
        "shifted AS (SELECT *, exp(s - max(s) OVER (PARTITION BY flow_id)) AS e FROM raw)",
    ],
    """SELECT flow_id, CAST(c AS INTEGER) AS class, (round(e / sum(e) OVER (PARTITION BY flow_id) + 1e-9, 6) + 0.0) AS prob
FROM shifted""",
)

# --- records with NaN and infinity --------------------------------------------------


def _value(j: int) -> str:
    """A record's value; null where it is not finite."""
    return f"({_filled(j)})"


ACCEPTED = RECORDS + [
    "f AS (SELECT row_id, kind, " + ", ".join(f"{_value(j)} AS f{j}" for j in range(N)) + " FROM r WHERE reason IS NULL)",
    "st AS (SELECT " + ", ".join(f"avg(f{j}) AS m{j}, stddev_pop(f{j}) AS s{j}" for j in range(N)) + " FROM f)",
    "z AS (SELECT f.*, " + ", ".join(f"(f{j} - m{j}) / CASE WHEN s{j} = 0 THEN 1 ELSE s{j} END AS z{j}" for j in range(N)) + " FROM f, st)",
]


def decided_ctes(source: str, names: list[str]) -> list[str]:
    """Margins, probabilities and decision over the feature columns ``names`` of ``source``."""
    classes = range(len(LABELS))
    return [
        "g AS (SELECT *, "
        + ", ".join(
            " + ".join(f"({((c * 7 + j * 3) % 11 - 5) / 10}) * {x}" for j, x in enumerate(names)) + f" + {(c % 4) / 10} AS g{c}"
            for c in classes
        )
        + f" FROM {source})",
        "tg AS (SELECT *, greatest(" + ", ".join(f"g{c}" for c in classes) + ") AS top FROM g)",
        "ex AS (SELECT *, " + ", ".join(f"exp(g{c} - top) AS e{c}" for c in classes) + " FROM tg)",
        "pr AS (SELECT *, " + ", ".join(f"e{c} / (" + " + ".join(f"e{i}" for i in classes) + f") AS p{c}" for c in classes) + " FROM ex)",
        "be AS (SELECT *, greatest(" + ", ".join(f"p{c}" for c in classes) + ") AS p_max FROM pr)",
        "dec AS (SELECT *, CASE WHEN p7 >= 0.15 THEN p7 ELSE p_max END AS prediction, CASE WHEN p7 >= 0.15 THEN 'normal' "
        + " ".join(f"WHEN p{c} = p_max THEN '{name}'" for c, name in enumerate(LABELS))
        + " END AS label FROM be)",
    ]


ODD_TEXT = {0: "nan", 1: "inf"}
RECORD_TEXT = " || ' | ' || ".join(
    f"'{f}: ' || "
    + (f"CASE WHEN kind = 7 THEN '{ODD_TEXT[j]}' ELSE " if j in ODD_TEXT else "")
    + (f"f{j}::BIGINT::VARCHAR" if f in INTEGER_FEATURES else f"round(f{j}, 6)::DECIMAL(38,6)::VARCHAR")
    + (" END" if j in ODD_TEXT else "")
    for j, f in enumerate(FEATURES)
)
ORACLES["nonfinite_records"] = with_ctes(
    ACCEPTED + decided_ctes("z", [f"z{j}" for j in range(N)]),
    f"""SELECT row_id, CASE WHEN kind = 7 THEN 0.0 ELSE (round(prediction + 1e-9, 6) + 0.0) END AS prediction,
  CASE WHEN kind = 7 THEN 'analysis' ELSE label END AS label, CASE WHEN kind = 7 THEN 'error' ELSE 'ok' END AS score_status,
  {RECORD_TEXT} AS text, f1::BIGINT AS stored_sbytes FROM dec""",
)
ORACLES["stream_scoring"] = ORACLES["nonfinite_records"]
ORACLES["stream_dead_letter"] = ORACLES["record_dead_letter"]
ORACLES["distinct_sources_window"] = with_ctes(
    PACKETS + ["p AS (SELECT * FROM packets WHERE ip_version = 4)"],
    f"""SELECT a.pkt_id, a.dst, count(DISTINCT b.src) AS sources FROM p a JOIN p b
  ON a.dst = b.dst AND b.ts_us > a.ts_us - {GAP} AND b.ts_us <= a.ts_us GROUP BY a.pkt_id, a.dst""",
)
ORACLES["unscaled_scores"] = with_ctes(
    OBSERVED
    + ["u AS (SELECT flow_id, " + ", ".join(f"{q(f)} / 1e6 AS u{j}" for j, f in enumerate(FEATURES)) + " FROM features)"]
    + decided_ctes("u", [f"u{j}" for j in range(N)]),
    "SELECT flow_id, (round(prediction + 1e-9, 6) + 0.0) AS prediction, label, 'unscaled' AS score_status FROM dec",
)
ORACLES["connection_counters"] = with_ctes(
    OBSERVED
    + ["r AS (SELECT flow_id, src, dst, dport, proto, row_number() OVER (ORDER BY last_us, flow_id) AS r FROM flows)"],
    """SELECT a.flow_id, count(*) FILTER (a.src = b.src) AS ct_src_ltm, count(*) FILTER (a.dst = b.dst) AS ct_dst_ltm,
  count(*) FILTER (a.dport = b.dport AND a.proto = b.proto) AS ct_srv_ltm, count(*) FILTER (a.src = b.src AND a.dport = b.dport) AS ct_src_dport_ltm,
  count(*) FILTER (a.src = b.src AND a.dst = b.dst) AS ct_dst_src_ltm FROM r a JOIN r b ON b.r BETWEEN a.r - 99 AND a.r GROUP BY a.flow_id""",
)
_FINE = ", ".join(f"CAST(round(z{j} / 1e-6 + 1e-3) AS BIGINT) AS w{j}" for j in range(N))
_EVERY = ", ".join(f"w{j}" for j in range(N))
ORACLES["near_duplicate_flows"] = with_ctes(
    SCORED
    + [
        f"fine AS (SELECT flow_id, {_FINE} FROM labelled)",
        f"points AS MATERIALIZED (SELECT min(flow_id) AS id, count(*) AS copies, {_EVERY} FROM fine GROUP BY {_EVERY})",
        "near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON a.id <> b.id AND "
        + " AND ".join(f"abs(a.w{j} - b.w{j}) <= 20000" for j in range(N))
        + ")",
        "reach(id, r) AS (SELECT id, id FROM points UNION SELECT near.b, reach.r FROM reach JOIN near ON near.a = reach.id)",
        "classes AS (SELECT id, min(r) AS near_id FROM reach GROUP BY id)",
    ],
    f"SELECT fine.flow_id, near_id, copies FROM fine JOIN points USING ({_EVERY}) JOIN classes USING (id)",
).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["pruned_search"] = ORACLES["search_all_vectors"]
ORACLES["index_left_out"] = """SELECT CASE WHEN vec_id % 15 = 0 THEN 'length' WHEN vec_id % 15 = 5 THEN 'missing'
  WHEN vec_id % 15 = 10 THEN 'not finite' ELSE 'held' END AS reason, count(*) AS rows FROM embeddings GROUP BY 1"""
ORACLES["corpus_positions"] = """WITH l AS (SELECT doc_id AS n, row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id % 7 = 3 AS broken,
    CASE doc_id % 10 WHEN 0 THEN doc_id // 10 WHEN 1 THEN doc_id // 20 END AS given FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY given, broken ORDER BY place) AS nth FROM l),
top AS (SELECT max(given) FILTER (NOT broken) AS most, count(*) FILTER (given IS NULL AND NOT broken AND place IN (SELECT given FROM l WHERE NOT broken)) AS hit FROM l)
SELECT CASE WHEN broken OR (given IS NOT NULL AND nth > 1) THEN NULL WHEN given IS NOT NULL THEN given
    WHEN hit > 0 THEN most + 1 + place ELSE place END AS doc_pos, n::VARCHAR AS text,
  CASE WHEN broken THEN 'malformed' WHEN given IS NOT NULL AND nth > 1 THEN 'repeated_position' END AS reason FROM g, top"""
ORACLES["bucket_upsert"] = ORACLES["results_upsert"]
ORACLES["bucket_delete"] = ORACLES["delete_by_id"]
ORACLES["range_table_scan"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000"
ORACLES["bucketed_lookup"] = ORACLES["key_lookup"]


def _tree_sql(t: int) -> str:
    """Tree ``t`` of the rule, as nested CASEs over v0, v1, ..."""

    def split(n: int, left: str, right: str) -> str:
        v, threshold = f"v{(7 * t + 5 * n) % N}", ((t * 5 + n * 3) % 9 - 4) / 8
        return f"CASE WHEN {v} IS NULL THEN {left if t % 2 == 0 else right} WHEN {v} < {threshold} THEN {left} ELSE {right} END"

    leaf = [str(((t * 3 + n * 7) % 13 - 6) / 10) for n in range(4)]
    return split(0, f"({split(1, leaf[0], leaf[1])})", f"({split(2, leaf[2], leaf[3])})")


_CLASSES = range(len(LABELS))
ORACLES["tree_probabilities"] = with_ctes(
    SCORED
    + [
        "lacking AS (SELECT flow_id, " + ", ".join(f"CASE WHEN (flow_id + {j}) % 7 <> 0 THEN z{j} END AS v{j}" for j in range(N)) + " FROM labelled)",
        "sums AS (SELECT flow_id, "
        + ", ".join(" + ".join(f"({_tree_sql(t)})" for t in range(c, 3 * len(LABELS), len(LABELS))) + f" + {(c % 4) / 10} AS t{c}" for c in _CLASSES)
        + " FROM lacking)",
        "powers AS (SELECT flow_id, " + ", ".join(f"exp(t{c}) AS e{c}" for c in _CLASSES) + " FROM sums)",
        "long AS (SELECT flow_id, unnest([" + ", ".join(map(str, _CLASSES)) + "]) AS class, unnest(["
        + ", ".join(f"e{c} / (" + " + ".join(f"e{i}" for i in _CLASSES) + ")" for c in _CLASSES)
        + "]) AS prob FROM powers)",
    ],
    "SELECT flow_id, CAST(class AS INTEGER) AS class, (round(prob + 1e-9, 6) + 0.0) AS prob FROM long",
)
ORACLES["stream_late_packets"] = with_ctes(
    OBSERVED, "SELECT flow_id, src, sport, dst, dport, proto, first_us, last_us, pkts, sbytes FROM flows"
)
ORACLES["stream_retry"] = with_ctes(
    OBSERVED,
    """SELECT flow_id AS row_id, CAST(CASE WHEN flow_id % 3 <> 0 THEN 1 WHEN flow_id % 5 < 3 THEN flow_id % 5 + 1 END AS INTEGER) AS attempt,
  CASE WHEN flow_id % 3 = 0 AND flow_id % 5 >= 3 THEN 'failed' ELSE 'scored' END AS "end" FROM flows""",
)
ORACLES["stream_folded_features"] = ORACLES["flow_features_bidirectional"]
ORACLES["index_recall"] = """WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT unnest(['default', 'all lists']) AS search, n * least(5, n - 1) AS wanted, true AS enough FROM n"""
