"""Flow totals -> the 18 features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowloom.schemas import FEATURE_SCHEMA, FEATURES, MIN_DUR_S, MIN_GAP_S, quoted

US = 1_000_000.0


def mean_or_zero(total: str, n: str) -> str:
    """Mean of ``n`` values, 0 when there are none."""
    return f"if({n} > 0, CAST({total} AS DOUBLE) / {n}, 0D)"


def std_or_zero(n: str, total: str, squares: str) -> str:
    """Population standard deviation from integer sums, 0 below two values.

    n * sum(x^2) - sum(x)^2 is formed in exact decimals, so nothing cancels.
    """
    exact = f"CAST({total} AS DECIMAL(18,0))"
    spread = f"CAST({n} AS DECIMAL(18,0)) * {squares} - {exact} * {exact}"
    return f"if({n} > 1, sqrt(CAST({spread} AS DOUBLE)) / {n}, 0D)"


def handshake_s(later_us: str, syn_us: str) -> str:
    """Seconds from the SYN to a reply, 0 when either is missing or the reply is earlier."""
    return f"greatest(coalesce(({later_us} - {syn_us}) / {US}D, 0D), 0D)"


def port_count(sport: str, dport: str) -> str:
    """Distinct non-zero ports (A5); every packet of a flow carries the same pair."""
    return f"CAST({sport} != 0 AS INT) + CAST({dport} != 0 AND {dport} != {sport} AS INT)"


def feature_expressions() -> dict[str, str]:
    """SQL expressions over the columns of ``flow_totals``."""
    dur = f"greatest({MIN_DUR_S}D, (last_us - first_us) / {US}D)"
    gap = f"{mean_or_zero('s_gap_sum', 's_gap_n')} / {US}D"
    return {
        "dur": dur,
        "sbytes": "sbytes",
        "dbytes": "dbytes",
        "Sload": f"log1p(sbytes / {dur})",
        "swin": "if(s_win_n > 0, s_win_sum div s_win_n, 0)",
        "stcpb": "coalesce(s_first_seq, 0)",
        "smeansz": f"log1p({mean_or_zero('payload_sum', 'pkts')})",
        "Sjit": f"{std_or_zero('s_gap_n', 's_gap_sum', 's_gap_sq')} / {US}D",
        "Djit": f"{std_or_zero('d_gap_n', 'd_gap_sum', 'd_gap_sq')} / {US}D",
        "Stime": f"log1p({dur})",
        "Sintpkt": f"log1p(greatest({gap}, {MIN_GAP_S}D))",
        "tcprtt": handshake_s("ack_us", "syn_us"),
        "synack": handshake_s("synack_us", "syn_us"),
        "ct_srv_src": port_count("sport", "dport"),
        "ct_srv_dst": "greatest(1, d_seq_n)",
        # Long-term counters are not tracked; a missing or zero counter means 1.
        "ct_dst_ltm": "1",
        "ct_src_ ltm": "1",
        "ct_dst_src_ltm": "1",
    }


def with_features(totals: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` followed by the 18 features in their fixed order and types."""
    texts = feature_expressions()
    types = {field.name: field.dataType.simpleString() for field in FEATURE_SCHEMA}
    return totals.selectExpr(
        *keep, *[f"CAST({texts[f]} AS {types[f]}) AS {quoted(f)}" for f in FEATURES]
    )
