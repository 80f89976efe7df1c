"""Preparation steps: fit = distributed aggregates -> small rules; apply = projections/filters.

Kinds of rule (one per column): ``fill``, ``standard``, ``minmax``, ``robust``, ``label``,
``onehot``, ``zscore``, ``iqr``.  A fitted pipeline is an ordered list of rules and is
replayed in that order with :func:`apply_rules` — projections and filters, so the replay is
one stage (a category list too long for the plan adds a join with its code table) and works on a
streaming DataFrame as well.

Category lists have no upper size.  A label list above INLINE_LABELS values and a one-hot list above
MAX_ONEHOT are code tables, ranked by range and joined on replay; the one-hot codes become ONE sparse vector column
``<column>_onehot`` in place of a column per category.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from kiln.functions.columns import categorical_columns, numeric_columns, qcol
from kiln.operators import stats
from kiln.operators.ordered import dense_codes
from kiln.session import scratch_path

# Label maps up to this many values travel inside the plan as a literal map; larger
# ones are written as a table and joined.
INLINE_LABELS = 1000
# Up to this many categories one-hot adds a column for each; above, one sparse vector column.
MAX_ONEHOT = 1000
NAN_LABEL = "nan"


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str
    params: dict = field(default_factory=dict, hash=False, compare=True)

    def to_dict(self, seq: int) -> dict:
        return {"seq": seq, "kind": self.kind, "column": self.column,
                "params": json.dumps(self.params, sort_keys=True)}

    @staticmethod
    def from_dict(d: dict) -> "Rule":
        p = d["params"]
        return Rule(d["kind"], d["column"], json.loads(p) if isinstance(p, str) else dict(p))


@dataclass(frozen=True)
class Step:
    """One requested operation, as recorded by the user (operation list entry)."""
    op: str                                # missing_values | normalization | encoding | outliers
    method: str | None = None              # standard|minmax|robust, label|onehot, zscore|iqr
    strategy: str | None = None            # mean|median|most_frequent|constant
    columns: tuple[str, ...] | None = None
    threshold: float | None = None
    fill_value: object = None
    approx: bool = False                    # quantile fits: one percentile_approx pass

    @staticmethod
    def from_dict(d: dict) -> "Step":
        cols = d.get("columns")
        return Step(op=d["operation"], method=d.get("method"), strategy=d.get("strategy"),
                    columns=tuple(cols) if cols else None, threshold=d.get("threshold"),
                    fill_value=d.get("fill_value"), approx=bool(d.get("approx", False)))


# ----------------------------------------------------------------------------- fit

def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _impute_columns(df: DataFrame, strategy: str, columns) -> list[str]:
    cols = list(columns) if columns else numeric_columns(df)
    if strategy not in ("mean", "median", "most_frequent", "constant"):
        raise ValueError(f"unknown imputation strategy: {strategy}")
    types = _types(df)
    bad = [c for c in cols if not isinstance(types[c], T.NumericType)]
    if strategy in ("mean", "median") and bad:
        raise ValueError(f"strategy {strategy!r} needs numeric columns, got: {', '.join(bad)}")
    return cols


def fit_impute(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None,
               fill_value=None, approx: bool = False) -> list[Rule]:
    """Fill values for mean / median / most_frequent / constant (fused per strategy)."""
    return _fit_together(df, [Step("missing_values", strategy=strategy, columns=tuple(columns) if columns else None,
                                   fill_value=fill_value, approx=approx)])


def fit_scale(df: DataFrame, method: str = "standard", columns: list[str] | None = None,
              approx: bool = False) -> list[Rule]:
    """Scaling statistics for all columns at once."""
    return _fit_together(df, [Step("normalization", method=method, columns=tuple(columns) if columns else None, approx=approx)])


def _impute_rule(c: str, dtype: T.DataType, step: Step, found: "_Found") -> Rule:
    strategy = step.strategy or "mean"
    if strategy == "mean":
        value = found.moments[c]["mean"]
    elif strategy == "median":
        value = found.quartiles[step.approx][c][1]
    elif strategy == "most_frequent":
        value = found.modes.get(c)
    elif step.fill_value is not None:
        value = step.fill_value
    else:
        value = 0.0 if isinstance(dtype, T.NumericType) else "missing_value"
    return Rule("fill", c, {"strategy": strategy, "fill_value": value})


def _scale_rule(c: str, step: Step, found: "_Found") -> Rule:
    method = step.method or "standard"
    if method == "standard":
        m = found.moments[c]
        return Rule("standard", c, {"mean": m["mean"], "std": m["std_pop"] or 1.0})
    if method == "minmax":
        lo, hi = found.moments[c]["min"], found.moments[c]["max"]
        return Rule("minmax", c, {"data_min": lo, "data_range": ((hi - lo) if lo is not None else None) or 1.0})
    q1, med, q3 = found.quartiles[step.approx][c]
    return Rule("robust", c, {"center": med, "scale": ((q3 - q1) if q1 is not None else None) or 1.0})


@dataclass
class _Found:
    """Statistics of one input that several steps read."""
    moments: dict = field(default_factory=dict)
    quartiles: dict = field(default_factory=dict)          # by the step's ``approx``
    modes: dict = field(default_factory=dict)
    encodings: dict = field(default_factory=dict)          # by method


def _columns_of(df: DataFrame, step: Step) -> list[str]:
    if step.op == "missing_values":
        return _impute_columns(df, step.strategy or "mean", step.columns)
    if step.op == "normalization":
        if (step.method or "standard") not in ("standard", "minmax", "robust"):
            raise ValueError(f"Unknown normalization method: {step.method}")
        return list(step.columns) if step.columns else numeric_columns(df)
    if step.op == "encoding":
        if (step.method or "label") not in ("label", "onehot"):
            raise ValueError(f"unknown encoding method: {step.method}")
        return list(step.columns) if step.columns else categorical_columns(df)
    if step.op == "outliers":
        return list(step.columns) if step.columns else numeric_columns(df)
    raise ValueError(f"unknown operation: {step.op}")


def _fit_together(df: DataFrame, steps: list[Step]) -> list[Rule]:
    """Rules of steps that all read ``df`` itself: each kind of statistic is taken once, for all their columns."""
    cols = [_columns_of(df, s) for s in steps]
    types = _types(df)

    def union(wants) -> list[str]:
        return list(dict.fromkeys(c for s, cs in zip(steps, cols) if wants(s) for c in cs))

    def impute(*names):
        return lambda s: s.op == "missing_values" and (s.strategy or "mean") in names

    def scale(*names):
        return lambda s: s.op == "normalization" and (s.method or "standard") in names

    found = _Found()
    found.moments = stats.moments(df, union(lambda s: impute("mean")(s) or scale("standard", "minmax")(s)))
    for approx in (False, True):
        found.quartiles[approx] = stats.quantiles(
            df, union(lambda s: s.approx is approx and (impute("median")(s) or scale("robust")(s))), [0.25, 0.5, 0.75], approx=approx)
    found.modes = stats.modes(df, union(impute("most_frequent")))
    for method in ("label", "onehot"):
        found.encodings[method] = {r.column: r for r in _encodings(df, method, union(
            lambda s: s.op == "encoding" and (s.method or "label") == method))}
    rules: list[Rule] = []
    for s, cs in zip(steps, cols):
        for c in cs:
            if s.op == "missing_values":
                rules.append(_impute_rule(c, types[c], s, found))
            elif s.op == "normalization":
                rules.append(_scale_rule(c, s, found))
            else:
                rules.append(found.encodings[s.method or "label"][c])
    return rules


def _label_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NAN_LABEL))


def _onehot_key(c: Column) -> Column:
    """Text that tells NULL from every category."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def fit_encode(df: DataFrame, method: str = "label", columns: list[str] | None = None) -> list[Rule]:
    """Sorted category lists."""
    return _fit_together(df, [Step("encoding", method=method, columns=tuple(columns) if columns else None)])


def _encodings(df: DataFrame, method: str, cols: list[str]) -> list[Rule]:
    """One capped collect of the distinct (column, value) pairs: below the cap every list is
    complete.  If the cap is hit, exact per-column counts decide which lists are small
    enough to collect; a longer list becomes a code table computed by range-partitioned ranking.
    """
    if not cols:
        return []
    limit = INLINE_LABELS if method == "label" else MAX_ONEHOT
    long = stats.unpivot(df, cols, "string")
    if method == "label":
        long = long.select("column", _label_key(F.col("value")).alias("value"))
    distinct = long.distinct()
    cap = len(cols) * (limit + 1)
    pairs = distinct.limit(cap).collect()               # hard bound on what reaches the driver
    per: dict[str, list] = {c: [] for c in cols}
    for r in pairs:
        per[r["column"]].append(r["value"])
    counts = {c: len(v) for c, v in per.items()}
    if len(pairs) == cap:
        # some list may be cut short: count exactly, then collect only the small ones again
        counts = {r["column"]: r["n"] for r in distinct.groupBy("column").agg(
            F.count(F.lit(1)).alias("n")).collect()}
        small = [c for c in cols if counts.get(c, 0) <= limit]
        per = {c: [] for c in small}
        if small:
            for r in distinct.where(F.col("column").isin(small)).collect():   # <= len(small) * limit
                per[r["column"]].append(r["value"])
    return [_code_table(df, method, c, counts[c]) if counts.get(c, 0) > limit else _inline_codes(method, c, per[c]) for c in cols]


def _inline_codes(method: str, c: str, values: list) -> Rule:
    if method == "label":
        return Rule("label", c, {"values": {v: i for i, v in enumerate(sorted(values))}})
    named = sorted(v for v in values if v is not None)
    has_null = len(named) < len(values)
    names = [f"{c}_{v}" for v in named]
    if has_null:                                          # the NULL column comes last, beside a text 'nan' under another name
        label = NAN_LABEL
        while f"{c}_{label}" in names:
            label += "_null"
        names.append(f"{c}_{label}")
    return Rule("onehot", c, {"categories": named + [NAN_LABEL] * has_null, "null_category": has_null, "encoded_columns": names})


def _code_table(df: DataFrame, method: str, c: str, n: int) -> Rule:
    """A rule whose codes are a table (``value``, ``code``) below the shared checkpoint folder; ``save_rules`` takes it along."""
    path = scratch_path(df.sparkSession, f"{method}-codes")
    if method == "label":
        dense_codes(df.select(_label_key(qcol(c)).alias("value")), "value", n_rows=n).write.parquet(path)
        return Rule("label", c, {"table": path, "n_values": int(n)})
    key = _onehot_key(qcol(c)).alias("value")
    codes = dense_codes(df.where(qcol(c).isNotNull()).select(key), "value", n_rows=n)
    last = df.where(qcol(c).isNull()).select(key).limit(1).withColumn("code", F.lit(n - 1))       # NULL comes last
    codes.unionByName(last).write.parquet(path)
    return Rule("onehot", c, {"table": path, "n_values": int(n), "vector": f"{c}_onehot"})


def fit_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0,
                 columns: list[str] | None = None, k: float = 1.5,
                 approx: bool = False) -> tuple[list[Rule], DataFrame]:
    """Columns in sequence, each fitted on the rows kept by the previous ones.

    No checkpoint is needed between columns: every fit reads only the columns used so
    far (the filters push into the scan), which costs less than writing all columns.
    """
    cols = list(columns) if columns else numeric_columns(df)
    rules = []
    cur = df
    for c in cols:
        if method == "zscore":
            m = stats.moments(cur, [c])[c]
            r = Rule("zscore", c, {"threshold": float(threshold), "mean": m["mean"], "std": m["std"]})
        elif method == "iqr":
            q1, q3 = stats.quantiles(cur, [c], [0.25, 0.75], approx=approx)[c]
            iqr = (q3 - q1) if q1 is not None else None
            r = Rule("iqr", c, {"Q1": q1, "Q3": q3, "IQR": iqr, "k": float(k)})
        else:
            raise ValueError(f"unknown outlier method: {method}")
        rules.append(r)
        cur = apply_rule(cur, r)
    return rules, cur


def fit_step(df: DataFrame, step: Step) -> tuple[list[Rule], DataFrame]:
    if step.op == "outliers":
        return fit_outliers(df, step.method or "zscore", 3.0 if step.threshold is None else step.threshold,
                            list(step.columns) if step.columns else None, approx=step.approx)
    rules = _fit_together(df, [step])
    return rules, apply_rules(df, rules)


def fit_pipeline(df: DataFrame, steps: list[Step | dict]) -> tuple[list[Rule], DataFrame]:
    """Fit the steps in order; each sees the output of the previous ones.

    A step whose columns no earlier step of its run has touched would see them unchanged, so such neighbours are fitted
    together, on the same input and in the same scans.  A run ends at an outlier step, which removes rows for all that
    follow, at a step that shares a column with the run, and at one that means "all columns" after an
    encoding, which changes what these are."""
    rules: list[Rule] = []
    cur = df
    run: list[Step] = []
    used: set[str] = set()

    def finish() -> None:
        nonlocal cur, run, used
        if run:
            new = _fit_together(cur, run)
            cur = apply_rules(cur, new)
            rules.extend(new)
            run, used = [], set()

    for s in steps:
        s = s if isinstance(s, Step) else Step.from_dict(s)
        if s.op == "outliers" or (not s.columns and any(r.op == "encoding" for r in run)):
            finish()
        known = set(cur.columns)
        if run and (not set(s.columns or ()) <= known or used & set(_columns_of(cur, s))):
            finish()
        if s.op == "outliers":
            new, cur = fit_step(cur, s)
            rules.extend(new)
            continue
        used |= set(_columns_of(cur, s))
        run.append(s)
    finish()
    return rules, cur


# --------------------------------------------------------------------------- apply

_PROJECTIONS = ("fill", "standard", "minmax", "robust", "label", "onehot")


def _projection(r: Rule, e: Column, dtype: T.DataType) -> list[tuple[str, Column, T.DataType]] | None:
    """Output columns of a projection rule applied to the expression ``e`` of its column
    (None: the rule leaves the column unchanged).  One-hot returns its new columns."""
    p, c = r.params, r.column
    x = F.nanvl(e.cast("double"), F.lit(None).cast("double"))     # NaN is missing, like NULL
    if r.kind == "fill":
        v = p["fill_value"]
        if v is None:
            return None
        if isinstance(dtype, T.NumericType):
            return [(c, F.coalesce(x, F.lit(float(v))), T.DoubleType())]
        return [(c, F.coalesce(e, F.lit(str(v))), dtype)]
    if r.kind == "standard":
        return [(c, (x - F.lit(p["mean"])) / F.lit(p["std"]), T.DoubleType())]
    if r.kind == "minmax":
        return [(c, (x - F.lit(p["data_min"])) / F.lit(p["data_range"]), T.DoubleType())]
    if r.kind == "robust":
        return [(c, (x - F.lit(p["center"])) / F.lit(p["scale"]), T.DoubleType())]
    if r.kind == "label":
        kv = []
        for k, v in sorted(p["values"].items(), key=lambda t: t[1]):
            kv += [F.lit(k), F.lit(int(v))]
        m = F.create_map(*kv) if kv else F.create_map().cast("map<string,int>")
        return [(c, F.try_element_at(m, _label_key(e)).cast("int"), T.IntegerType())]
    if r.kind == "onehot":
        at_null = max((i for i, v in enumerate(p["categories"]) if v == NAN_LABEL), default=-1) if p.get("null_category") else -1
        return [(name, (e.isNull() if i == at_null else F.coalesce(e.cast("string") == F.lit(v), F.lit(False))).cast("double"), T.DoubleType())
                for i, (v, name) in enumerate(zip(p["categories"], p["encoded_columns"]))]
    raise ValueError(f"not a projection rule: {r.kind}")


def _keep(r: Rule, e: Column) -> Column | None:
    """Row condition of an outlier rule over the expression ``e`` of its column."""
    p = r.params
    x = F.nanvl(e.cast("double"), F.lit(None).cast("double"))
    if r.kind == "zscore":
        mean, std, thr = p["mean"], p["std"], p["threshold"]
        if std is None or std == 0:
            return e.isNotNull()
        return F.abs((x - F.lit(mean)) / F.lit(std)) < F.lit(thr)
    if r.kind == "iqr":
        q1, q3, iqr, k = p["Q1"], p["Q3"], p["IQR"], p.get("k", 1.5)
        if q1 is None:
            return None
        out = (x < F.lit(q1 - k * iqr)) | (x > F.lit(q3 + k * iqr))
        return x.isNull() | ~out
    raise ValueError(f"not a filter rule: {r.kind}")


def _coded(df: DataFrame, r: Rule, key: Column) -> DataFrame:
    """``df`` with ``_code`` from the rule's code table: a left join, which Spark broadcasts by the table's bytes or splits
    where a key is hot."""
    table = df.sparkSession.read.parquet(r.params["table"]).select(F.col("value").alias("_key"), F.col("code").alias("_code"))
    return df.withColumn("_key", key).join(table, "_key", "left").drop("_key")


def _label_join(df: DataFrame, r: Rule) -> DataFrame:
    joined = _coded(df, r, _label_key(qcol(r.column)))
    return joined.select(*[(F.col("_code").cast("int").alias(x) if x == r.column else qcol(x)) for x in df.columns])


def _onehot_join(df: DataFrame, r: Rule) -> DataFrame:
    """One sparse vector column in place of ``r.column``; a category that the fit did not see is all zeros."""
    n, name = r.params["n_values"], r.params["vector"]
    if name in df.columns:
        raise ValueError(f"one-hot of {r.column!r} would replace the column {name!r}; rename one of them")
    coded = _coded(df, r, _onehot_key(qcol(r.column)))
    return coded.select(*[qcol(x) for x in df.columns if x != r.column], _unit_vector(F.col("_code"), n).alias(name))


def _unit_vector(code: Column, n: int) -> Column:
    """A sparse vector of size ``n`` with 1.0 at ``code``; all zeros where the code is NULL.

    Spark ML's OneHotEncoder would name every category in the column's metadata, on the driver and in every plan."""
    from pyspark.ml.linalg import VectorUDT

    at, values = F.array(code.cast("int")), F.array(F.lit(1.0))
    none = F.filter(at, lambda i: i.isNotNull()), F.filter(values, lambda _: code.isNotNull())
    parts = F.struct(F.lit(0).alias("type"), F.lit(n).alias("size"), none[0].alias("indices"), none[1].alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema).getField("v")


def vector_entries(vector: Column) -> Column:
    """The struct (size, indices, values) of a sparse vector column, without leaving the JVM."""
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), "v struct<size:int,indices:array<int>,values:array<double>>").getField("v")


def apply_rule(df: DataFrame, r: Rule) -> DataFrame:
    return apply_rules(df, [r])


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Replay fitted rules in their recorded order (projections and filters only).

    Consecutive projection rules are composed into ONE select (expressions substituted into
    each other), so a wide table with many rules is analysed once per run, not once per
    rule; an outlier rule becomes a filter over the composed expressions.
    """
    cols = list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = {c: qcol(c) for c in cols}
    cur = df
    dirty = False

    def flush():
        nonlocal cur, exprs, dirty
        if dirty:
            cur = cur.select(*[exprs[c].alias(c) for c in cols])
            exprs = {c: qcol(c) for c in cols}
            dirty = False

    for r in rules:
        if r.column not in exprs:
            raise ValueError(f"rule for unknown column {r.column!r}")
        if r.kind in ("zscore", "iqr"):
            flush()
            cond = _keep(r, exprs[r.column])
            if cond is not None:
                cur = cur.where(cond)
            continue
        if "table" in r.params:
            flush()
            cur = (_label_join if r.kind == "label" else _onehot_join)(cur, r)
            cols, types = list(cur.columns), {f.name: f.dataType for f in cur.schema.fields}
            exprs = {c: qcol(c) for c in cols}
            continue
        if r.kind not in _PROJECTIONS:
            raise ValueError(f"unknown rule kind: {r.kind}")
        out = _projection(r, exprs[r.column], types[r.column])
        if out is None:
            continue
        if r.kind == "onehot":
            pos = cols.index(r.column)
            del cols[pos]
            exprs.pop(r.column)
            types.pop(r.column)
            for name, e, t in out:
                if name in exprs:
                    raise ValueError(f"one-hot of {r.column!r} would replace the column {name!r}; rename one of them")
                cols.append(name)
                exprs[name] = e
                types[name] = t
        else:
            name, e, t = out[0]
            exprs[name] = e
            types[name] = t
        dirty = True
    flush()
    return cur


def rules_to_json(rules: list[Rule]) -> str:
    return json.dumps([r.to_dict(i) for i, r in enumerate(rules)])


def rules_from_json(text: str) -> list[Rule]:
    return [Rule.from_dict(d) for d in sorted(json.loads(text), key=lambda d: d["seq"])]


# ------------------------------------------------------------ reference-style entry points
def handle_missing_values(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None,
                          fill_value=None) -> tuple[DataFrame, list[Rule]]:
    rules = fit_impute(df, strategy, columns, fill_value)
    return apply_rules(df, rules), rules


def normalize_data(df: DataFrame, method: str = "standard",
                   columns: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    rules = fit_scale(df, method, columns)
    return apply_rules(df, rules), rules


def encode_categorical(df: DataFrame, method: str = "label",
                       columns: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    rules = fit_encode(df, method, columns)
    return apply_rules(df, rules), rules


def remove_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0,
                    columns: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    rules, out = fit_outliers(df, method, threshold, columns)
    return out, rules
