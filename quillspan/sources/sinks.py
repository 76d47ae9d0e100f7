"""Writers of results: CSV and JSON by Spark, small reports as strings from collected summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as strings of ``digits`` decimals."""
    return df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header, a folder for each value of ``by``."""
    w = rounded(df).write.mode(mode).option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def nested_results(overall: DataFrame, per_type: DataFrame, key: str = "model") -> DataFrame:
    """(key, json): overall scores with a map of those per type."""
    cols = [c for c in per_type.columns if c not in (key, "type")]
    types = per_type.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", F.struct(*cols).alias("s"))))).alias("per_type"))
    rest = [c for c in overall.columns if c != key]
    return overall.join(types, key, "left").select(key, F.to_json(F.struct(F.struct(*rest).alias("overall"), "per_type")).alias("json"))


def consolidated(results: dict[str, DataFrame]) -> DataFrame:
    """All datasets' results with a dataset column; columns that one lacks are null."""
    out = None
    for name, df in results.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def append_calls(calls: DataFrame, path: str) -> None:
    """Append to the log of model calls."""
    calls.write.mode("append").json(path)


def _cells(rows, cols) -> list[list[str]]:
    return [[f"{r[c]:.4f}" if isinstance(r[c], float) else "" if r[c] is None else str(r[c]) for c in cols] for r in rows]


def summary_rows(df: DataFrame, limit: int) -> list:
    """The rows of a summary for a report; more than ``limit`` raise, nothing is left out."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: a report takes a summary")
    return rows


def markdown(ranked: DataFrame, title: str, limit: int = 1000) -> str:
    """A report of a ranking: best model and table (a summary of one row per model, ``limit`` at most)."""
    cols, rows = ranked.columns, summary_rows(ranked.orderBy("rank"), limit)
    best = f"Best: {rows[0]['model']}\n\n" if rows else ""
    table = "\n".join("| " + " | ".join(c) + " |" for c in [cols, ["---"] * len(cols), *_cells(rows, cols)])
    return f"# {title}\n\n{best}{table}\n"


def latex(df: DataFrame, limit: int = 1000) -> str:
    cols = df.columns
    body = [" & ".join(c.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&") for c in r) + r" \\" for r in [cols, *_cells(summary_rows(df, limit), cols)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(cols) + "}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"])


def html(df: DataFrame, title: str, limit: int = 1000) -> str:
    from html import escape

    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    return f"<h1>{escape(title)}</h1><table>{row(df.columns, 'th')}{''.join(row(r, 'td') for r in _cells(summary_rows(df, limit), df.columns))}</table>"


def chart_data(per_type: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Long rows (model, type, metric, value) for bar, radar and grouped charts."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return per_type.select(*[c for c in ("model", "type") if c in per_type.columns], F.explode(pairs).alias("x")).select(*[c for c in ("model", "type") if c in per_type.columns], "x.*")
