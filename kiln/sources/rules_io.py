"""Fitted rules saved and loaded as a folder (any shared file system).

``manifest`` is the rule list as JSON; ``tables-<id>`` holds the code tables of long category lists as Parquet, one folder
each, named in the manifest relative to the rule folder.  So a saved folder needs nothing outside itself and can be moved.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import SparkSession, types as T

from kiln.operators.prep import Rule

RULES_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("params", T.StringType(), False),
])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_rules(spark: SparkSession, rules: list[Rule], path: str, mode: str = "overwrite") -> str:
    """Write the rules and their code tables below ``path``.

    The manifest comes last and names fresh tables, so rules loaded from ``path`` can be saved there again; tables
    that it no longer names go afterwards."""
    path = path.rstrip("/")
    if mode not in ("overwrite", "error", "errorifexists"):
        raise ValueError(f"rules are saved with mode overwrite or error, not {mode!r}")
    fs, root = _fs(spark, path)
    if mode != "overwrite" and fs.exists(root):
        raise ValueError(f"{path} exists")
    tables = f"tables-{uuid.uuid4().hex[:12]}"
    out = []
    for i, r in enumerate(rules):
        if "table" in r.params:
            spark.read.parquet(r.params["table"]).write.parquet(f"{path}/{tables}/{i}")
            r = replace(r, params={**r.params, "table": f"{tables}/{i}"})
        out.append(tuple(r.to_dict(i).values()))
    spark.createDataFrame(out, RULES_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("tables-") and name != tables:
            fs.delete(f.getPath(), True)
    return path


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Read rules back, ordered by their sequence number (also from a folder of bare JSON rules)."""
    path = path.rstrip("/")
    fs, manifest = _fs(spark, f"{path}/manifest")
    rows = spark.read.schema(RULES_SCHEMA).json(f"{path}/manifest" if fs.exists(manifest) else path).orderBy("seq").collect()
    rules = [Rule.from_dict(r.asDict()) for r in rows]
    return [replace(r, params={**r.params, "table": f"{path}/{r.params['table']}"})
            if str(r.params.get("table", "")).startswith("tables-") else r for r in rules]


def rules_from_reference_state(state: dict) -> list[Rule]:
    """Rules from a state document of the reference application (``transformation_rules``
    with its four maps), in that application's replay order: encode, scale, fill, outliers.

    Min-max entries hold the scaler's offset ``min`` and multiplier ``scale``
    (x' = x * scale + min); they are turned into ``data_min``/``data_range`` so the replay
    reproduces the fitted transform.
    """
    tr = state.get("transformation_rules", state)
    out: list[Rule] = []
    for col, m in tr.get("encoding_maps", {}).items():
        if m["type"] == "label":
            out.append(Rule("label", col, {"values": {str(k): int(v) for k, v in m["values"].items()}}))
        elif m["type"] == "onehot":
            cats = [str(c) for c in m["categories"]]
            out.append(Rule("onehot", col, {"categories": cats, "null_category": "nan" in cats,
                                            "encoded_columns": m.get("encoded_columns")
                                            or [f"{col}_{c}" for c in cats]}))
    for col, p in tr.get("normalizations", {}).items():
        if p["type"] == "standard":
            out.append(Rule("standard", col, {"mean": p["mean"], "std": p["std"] or 1.0}))
        elif p["type"] == "minmax":
            scale = p["scale"] or 1.0
            out.append(Rule("minmax", col, {"data_min": -p["min"] / scale, "data_range": 1.0 / scale}))
        elif p["type"] == "robust":
            out.append(Rule("robust", col, {"center": p["center"], "scale": p["scale"] or 1.0}))
    for col, r in tr.get("missing_value_rules", {}).items():
        out.append(Rule("fill", col, {"strategy": r.get("strategy"), "fill_value": r["fill_value"]}))
    for col, r in tr.get("outlier_rules", {}).items():
        prm = r["params"]
        if r["method"] == "zscore":
            out.append(Rule("zscore", col, {"threshold": r["threshold"], "mean": prm["mean"], "std": prm["std"]}))
        else:
            out.append(Rule("iqr", col, {"Q1": prm["Q1"], "Q3": prm["Q3"], "IQR": prm["IQR"], "k": 1.5}))
    return out


def load_reference_state(spark: SparkSession, path: str) -> list[Rule]:
    """Read one state JSON file of the reference application (a small document) into rules."""
    import json
    text = spark.read.text(path, wholetext=True).collect()[0][0]
    return rules_from_reference_state(json.loads(text))
