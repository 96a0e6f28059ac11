"""Result tables: the scan of a result tree, averages, improvements, pivots and their text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagspark.sources.tables import write_text

from .metrics import quantiles

SETTING = r"/(\d+[_-]\d+)/"
#: Methods that know the target: never the best.
EXCLUDED = r"(^|/)oracle_"
#: Relative differences of averages that are as small come from the order of summation.
ROUNDING = 1e-12
RECORD = "dataset string, setting string, method string, split string, metric string, value double, path string"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, setting, method, split, metric, value, path) of the JSON files under a folder.

    Metric lists, summaries and flat evaluation maps are told apart by their file names.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "*.json").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/")
    name = F.substring_index("path", "/", -1)
    rows = files.select(path.alias("path"), F.col("value").alias("json")).withColumns(
        {"name": name, "dataset": F.regexp_extract("path", r"/([^/]+)/\d+[_-]\d+/", 1), "setting": F.regexp_extract("path", SETTING, 1)}
    )
    rows = rows.where("setting <> ''").withColumns({"run": F.regexp_extract("path", r"/\d+[_-]\d+/([^/]+)/", 1), "folder": F.element_at(F.split("path", "/"), -2)})
    lists = "array<struct<split:string,baseline:string,mse:double,mae:double,nmse:double>>"
    table = rows.where(F.col("name").isin("baseline_metrics.json", "gate_metrics.json")).select("*", F.explode(F.from_json("json", lists)).alias("r"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"r.{m}").alias("value")) for m in ("mse", "mae", "nmse")]))
    table = table.select("dataset", "setting", F.concat_ws("/", "run", "r.baseline").alias("method"), F.col("r.split").alias("split"), each.alias("m"), "path")
    table = table.select("dataset", "setting", "method", "split", "m.metric", "m.value", "path")
    summary = rows.where("name = 'univariate_summary.json'").select("*", F.explode(F.from_json("json", "map<string,map<string,string>>")).alias("split", "metrics"))
    summary = summary.select("*", F.explode("metrics").alias("metric", "cell"))
    number = F.coalesce(F.get_json_object("cell", "$.mean"), F.col("cell")).try_cast("double")
    summary = summary.select("dataset", "setting", F.concat_ws("/", F.lit("direct"), "folder").alias("method"), "split", "metric", number.alias("value"), "path")
    flat = rows.where("name = 'eval_metrics.json'").select("*", F.explode(F.from_json("json", "map<string,double>")).alias("key", "value"))
    metric = F.regexp_extract("key", r"^(.+)_(mse|mae|nmse)$", 2)
    variant = F.regexp_replace(F.regexp_extract("key", r"^(.+)_(mse|mae|nmse)$", 1), "^adapted$", "adapter")
    flat = flat.where(metric != "").select("dataset", "setting", F.concat_ws("/", "run", variant).alias("method"), F.lit("eval").alias("split"), metric.alias("metric"), "value", "path")
    return table.unionByName(summary).unionByName(flat)


def write_metrics(scores: DataFrame, root: str, run: str) -> None:
    """Scores (dataset, setting, split, method, mse, mae, nmse) as a result tree that discover() reads: a metric list a dataset and setting.

    A list is a row a split and method; the driver passes on one at a time.
    """
    cell = F.struct("split", F.col("method").alias("baseline"), "mse", "mae", "nmse")
    lists = scores.groupBy("dataset", "setting").agg(F.to_json(F.array_sort(F.collect_list(cell))).alias("json"))
    for row in lists.toLocalIterator():
        write_text(scores.sparkSession, f"{root}/{row['dataset']}/{row['setting']}/{run}/baselines/baseline_metrics.json", row["json"])


def filtered(records: DataFrame, metric: str = "mse", split: str = "eval", datasets=None, settings=None, per_dataset: dict | None = None, methods=None) -> DataFrame:
    """Records of a metric and split (any case); a dataset's own settings replace the global ones."""
    rows = records.where((F.lower("metric") == metric.lower()) & (F.lower("split") == split.lower()))
    if datasets:
        rows = rows.where(F.col("dataset").isin(list(datasets)))
    own = per_dataset or {}
    keep = F.col("setting").isin(list(settings)) if settings else F.lit(True)
    for name, some in own.items():
        keep = F.when(F.col("dataset") == name, F.col("setting").isin(list(some))).otherwise(keep)
    rows = rows.where(keep)
    last = F.substring_index("method", "/", -1)
    return rows.where(F.col("method").isin(list(methods)) | last.isin(list(methods))) if methods else rows.where((last != "vanilla") | (F.col("method") == "vanilla"))


def averaged(records: DataFrame) -> DataFrame:
    """(dataset, setting, method, value): mean of the finite values."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.col("value"))
    return records.groupBy("dataset", "setting", "method").agg(F.avg(finite).alias("value"))


def improvements(means: DataFrame, reference: str, higher_is_better: bool = False) -> DataFrame:
    """(level, dataset, setting, method, value, ref, improvement_pct): improvement of averages by dataset, by setting and overall."""
    rows = means.groupingSets([[F.col("dataset"), F.col("method")], [F.col("setting"), F.col("method")], [F.col("method")]], "dataset", "setting", "method").agg(
        F.avg("value").alias("value"), F.grouping("dataset").alias("gd"), F.grouping("setting").alias("gs")
    )
    level = F.when(F.col("gd") == 0, "dataset").when(F.col("gs") == 0, "setting").otherwise("overall")
    rows = rows.withColumn("level", level).drop("gd", "gs")
    # The reference's average is its own row's, not summed again in another order: its improvement is exactly 0.
    ref = F.max(F.when(F.col("method") == reference, F.col("value"))).over(Window.partitionBy("level", "dataset", "setting"))
    change = (F.col("ref") - F.col("value")) * (-1.0 if higher_is_better else 1.0)
    return rows.withColumn("ref", ref).select("level", "dataset", "setting", "method", "value", "ref", F.when(F.abs("ref") > 0, change / F.abs("ref") * 100).alias("improvement_pct"))


def table(means: DataFrame, methods: list[str], reference: str, higher_is_better: bool = False) -> DataFrame:
    """(level, dataset, setting, each method, each method + '_pct'): cells, and their averages by dataset, by setting and overall.

    One aggregation over grouping sets, pivoted; improvements over the reference come from the
    columns beside them. A method or reference without a value leaves nulls.
    """
    d, s, m = F.col("dataset"), F.col("setting"), F.col("method")
    levels = means.groupingSets([[d, s, m], [d, m], [s, m], [m]], d, s, m).agg(F.avg("value").alias("value"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 2, "dataset").when(F.col("g") == 4, "setting").otherwise("overall")
    wide = levels.withColumn("level", level).groupBy("level", "dataset", "setting").pivot("method", list(dict.fromkeys([*methods, reference]))).agg(F.first("value"))
    ref = F.col(f"`{reference}`")
    change = lambda v: (ref - v) * (-1.0 if higher_is_better else 1.0)
    pct = [F.when(F.abs(ref) > 0, change(F.col(f"`{n}`")) / F.abs(ref) * 100).alias(f"{n}_pct") for n in methods]
    return wide.select("level", "dataset", "setting", *[F.col(f"`{n}`") for n in methods], *pct)


def column_order(methods: list[str], reference: str, exclude: str = EXCLUDED) -> list[str]:
    """Column heads: the reference, then by name in any case, and those that take no part in the marking of the best last."""
    return sorted(methods, key=lambda m: (m != reference, bool(re.search(exclude, m)), m.casefold(), m))


def positive_only(means: DataFrame, reference: str, higher_is_better: bool = False) -> DataFrame:
    """The reference and the methods that improve on it overall, by more than the rounding of sums: equal forecasts are no improvement in any order of summation."""
    better = (F.col("improvement_pct") > ROUNDING * 100) | (F.col("method") == reference)
    good = improvements(means, reference, higher_is_better).where((F.col("level") == "overall") & better).select("method")
    return means.join(good, "method", "left_semi")


def pivoted(means: DataFrame, methods: list[str]) -> DataFrame:
    """One row a dataset and setting, one column a method."""
    return means.groupBy("dataset", "setting").pivot("method", methods).agg(F.avg("value"))


def best_flags(means: DataFrame, higher_is_better: bool = False, exclude: str = EXCLUDED) -> DataFrame:
    """means with best: the row's best value among the methods that are not excluded."""
    row = Window.partitionBy("dataset", "setting")
    inside = F.when(~F.col("method").rlike(exclude), F.col("value"))
    edge = (F.max if higher_is_better else F.min)(inside).over(row)
    close = F.abs(F.col("value") - edge) <= F.greatest(F.lit(ROUNDING) * F.greatest(F.abs("value"), F.abs(edge)), F.lit(1e-15))
    return means.withColumn("best", F.coalesce(close & inside.isNotNull(), F.lit(False)))


def scale_exponents(means: DataFrame, reference: str) -> DataFrame:
    """(dataset, setting, exponent): floor(log10) of the median size of the reference's values."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0)
    rows = means.where((F.col("method") == reference) & finite)
    median = quantiles(rows.withColumn("value", F.abs("value")), ["dataset", "setting"], "value", [0.5])
    return median.select("dataset", "setting", F.floor(F.log10("quantile")).cast("long").alias("exponent"))


def sweep_matrix(means: DataFrame, variants: list[str], runs: list[str], reference: float, higher_is_better: bool = False) -> DataFrame:
    """(variant, run, value, improvement_pct) of every cell; a method is run/variant, a missing cell null."""
    spark = means.sparkSession
    cells = spark.createDataFrame([(v, r, f"{r}/{v}") for v in variants for r in runs], "variant string, run string, method string")
    have = means.groupBy("method").agg(F.avg("value").alias("value"))
    change = (F.lit(float(reference)) - F.col("value")) * (-1.0 if higher_is_better else 1.0) / abs(reference) * 100
    return cells.join(have, "method", "left").select("variant", "run", "value", change.alias("improvement_pct"))


def setting_key(setting: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", setting))


def latex_escape(text: str) -> str:
    return re.sub(r"([&%$#_{}])", r"\\\1", text)


def _tabular(heads: list[str], lines: list[list[str]], rules: set[int], caption: str, label: str, left: int = 2) -> str:
    """LaTeX of a table whose first columns are names; rules are numbers of lines that a rule goes before."""
    out = [r"\begin{table}", r"\centering", rf"\begin{{tabular}}{{{'l' * left}{'r' * (len(heads) - left)}}}", r"\toprule", " & ".join(heads) + r" \\", r"\midrule"]
    for i, cells in enumerate(lines):
        out += [r"\midrule"] * (i in rules) + [" & ".join(cells) + r" \\"]
    return "\n".join([*out, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])


def _percent(x: float | None) -> str:
    return "--" if x is None or x != x else rf"{x:.2f}\%"


def render(
    means: DataFrame, methods: list[str], reference: str, decimals: int = 2, caption: str = "", label: str = "", higher_is_better: bool = False, scales: dict[str, int] | None = None, levels: tuple[str, ...] = ("overall",)
) -> str:
    """The main table as LaTeX: cells, then improvement rows of the wanted levels; the driver holds its cells only.

    scales gives a row's power of ten by dataset/setting or by dataset, in place of the median's.
    """
    flags = {(r["dataset"], r["setting"], r["method"]): r for r in best_flags(means, higher_is_better).collect()}
    scale, own = {(r["dataset"], r["setting"]): r["exponent"] for r in scale_exponents(means, reference).collect()}, scales or {}
    lines = []
    for d, s in sorted({(d, s) for d, s, _ in flags}, key=lambda x: (x[0].casefold(), x[0], setting_key(x[1]))):
        e = own.get(f"{d}/{s}", own.get(d, scale.get((d, s)) or 0))
        cells = []
        for m in methods:
            r = flags.get((d, s, m))
            if r is None or r["value"] is None or r["value"] != r["value"]:
                cells.append("--")
                continue
            text = f"{r['value'] / 10.0**e:.{decimals}f}"
            cells.append(rf"\textbf{{{text}}}" if r["best"] else text)
        unit = rf" ($10^{{{e}}}$)" if e else ""
        lines.append([latex_escape(d), latex_escape(s) + unit, *cells])
    changes = [r for r in table(means, methods, reference, higher_is_better).collect() if r["level"] in levels]
    for r in sorted(changes, key=lambda r: (levels.index(r["level"]), (r["dataset"] or "").casefold(), setting_key(r["setting"] or ""))):
        lines.append([r["level"].capitalize(), latex_escape(r["dataset"] or r["setting"] or ""), *[_percent(r[f"{m}_pct"]) for m in methods]])
    heads = ["Dataset", "Setting", *(latex_escape(m) for m in methods)]
    return _tabular(heads, lines, {len(lines) - len(changes)}, caption, label)


def render_sweep(matrix: DataFrame, variants: list[str], runs: list[str], decimals: int = 3, caption: str = "", label: str = "", higher_is_better: bool = False) -> str:
    """The matrix of a sweep as LaTeX: a variant a line, value and improvement of each run, the best of a run bold."""
    cells = {(r["variant"], r["run"]): (r["value"], r["improvement_pct"]) for r in matrix.collect()}  # variants x runs
    edge = max if higher_is_better else min
    best = {run: edge((v for (_, r), (v, _) in cells.items() if r == run and v is not None), default=None) for run in runs}

    def text(variant: str, run: str) -> str:
        value, change = cells.get((variant, run), (None, None))
        if value is None:
            return "--"
        shown = rf"\textbf{{{value:.{decimals}f}}}" if value == best[run] else f"{value:.{decimals}f}"
        return f"{shown} ({_percent(change)})"

    lines = [[latex_escape(v), *[text(v, r) for r in runs]] for v in variants]
    return _tabular(["Variant", *(latex_escape(r) for r in runs)], lines, set(), caption, label, left=1)
