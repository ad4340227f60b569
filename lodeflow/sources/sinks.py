"""Writers of results: reports, logs, run tables."""

from __future__ import annotations

import logging
import logging.handlers
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, form: str = "json", digits: int = 4, mode: str = "overwrite") -> None:
    """JSON, or CSV with a header and fixed digits."""
    if form == "csv":
        df = df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows; ids are given when the log is read (``files.numbered``), so writers need not agree on a number."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def log_run(spark, path: str, run: str, params: dict, metrics: dict) -> None:
    """One row for each parameter and metric of a run."""
    rows = [(run, "param", k, str(v), None) for k, v in params.items()] + [(run, "metric", k, None, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run string, kind string, name string, text string, value double").write.mode("append").parquet(path)


def logger(name: str, folder: str | None = None, size: int = 10 << 20, keep: int = 5) -> logging.Logger:
    """A logger to the console and, given a folder, to files that rotate."""
    out = logging.getLogger(name)
    if not out.handlers:
        out.setLevel(logging.INFO)
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            os.makedirs(folder, exist_ok=True)
            handlers.append(logging.handlers.RotatingFileHandler(os.path.join(folder, f"{name}.log"), maxBytes=size, backupCount=keep))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            out.addHandler(h)
    return out
