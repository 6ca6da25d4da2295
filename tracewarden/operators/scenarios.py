"""What-if edits of feature tables: how would the detectors see a changed entity?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hubs the extra edges lead to.
HUBS = ("8.8.8.8", "1.1.1.1", "192.168.1.1")


def _masked(df: DataFrame, entity: str, target: str, edits: dict[str, Column]) -> DataFrame:
    on = F.col(entity) == target
    return df.withColumns({c: F.when(on, e.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, e in edits.items() if c in df.columns})


def high_entropy_dns(df: DataFrame, target: str, intensity: float = 1.0, entity: str = "src_ip") -> DataFrame:
    entropy = F.least(F.greatest(F.col("domain_entropy") + 2.5 * intensity, F.lit(0.0)), F.lit(8.0))
    return _masked(
        df, entity, target,
        {"domain_nunique": F.col("domain_nunique") + 50 * intensity, "domain_entropy": entropy, "bytes_out_sum": F.col("bytes_out_sum") + 15000 * intensity},
    )


def sparse_beacon(df: DataFrame, target: str, intensity: float = 1.0, entity: str = "src_ip") -> DataFrame:
    return _masked(
        df, entity, target,
        {
            "bytes_in_sum": F.col("bytes_in_sum") + 500 * intensity,
            "bytes_out_sum": F.col("bytes_out_sum") + 100 * intensity,
            "domain_entropy": F.greatest(F.col("domain_entropy") - intensity, F.lit(0.0)),
        },
    )


def bounded_shrink(df: DataFrame, target: str, share: float = 0.15, entity: str = "src_ip") -> DataFrame:
    """Shrink the volume columns that are present and clear the reputation; results are fractional."""
    columns = [c for c in ("bytes_in_sum", "bytes_out_sum", "dst_port_nunique", "delta_bytes_in") if c in df.columns]
    wide = df.withColumns({c: F.col(c).cast("double") for c in columns})
    edits = {c: F.col(c) * (1.0 - share) for c in columns}
    return _masked(wide, entity, target, {**edits, "ip_reputation_score": F.lit(0.0)})


def extra_edges(df: DataFrame, target: str, edges: int = 10, hubs: Sequence[str] = HUBS, entity: str = "src_ip", seed: int = 0) -> DataFrame:
    """Raw flows gain ``edges`` seeded contacts from the target to hubs; windowed rows gain ports instead."""
    if "dst_ip" not in df.columns:
        return _masked(df, entity, target, {"dst_port_nunique": F.col("dst_port_nunique") + edges})
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003))
    fields = {
        entity: F.lit(target),
        "dst_ip": F.element_at(F.array(*[F.lit(h) for h in hubs]), (draw % len(hubs) + 1).cast("int")),
        "bytes_out": F.lit(40) + draw % 61,
    }
    made = df.sparkSession.range(edges).select(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )
    return df.unionByName(made)
