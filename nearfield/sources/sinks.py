"""Where study results go: ordered CSV tables, strict JSON, a Markdown report, chart data."""

from __future__ import annotations

import csv
import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import InvalidParameter
from nearfield.operators import study

ORDERS = {
    "measurements": ["implementation", "case_name", "metric", "collection", "run_index", "source"],
    "summary": ["implementation", "case_name", "metric"],
    "winners": ["case_name", "metric"],
    "pairwise": ["question", "case_name"],
}


@dataclass(frozen=True)
class Analysis:
    """The frames of one analysis, and the digest of what they were made from."""

    records: DataFrame
    summaries: DataFrame
    winners: DataFrame
    pairwise: DataFrame
    audit: DataFrame
    input_digest: str

    @classmethod
    def of(cls, records: DataFrame, collections: DataFrame, input_digest: str) -> Analysis:
        summaries = study.summarize(records).persist()
        return cls(records, summaries, study.winners(summaries).persist(), study.contrasts(summaries).persist(), study.audit(records, collections).persist(), input_digest)


def write_csv(frame: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV parts with headers, in order over all parts; for tables of any size."""
    frame.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def write_one_csv(frame: DataFrame, path: Path, order: list[str]) -> None:
    """One local CSV file, streamed through the driver partition by partition; empty if there are no rows."""
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = None
        for row in frame.orderBy(*order).toLocalIterator():
            if writer is None:
                writer = csv.writer(out)
                writer.writerow(frame.columns)
            writer.writerow(list(row))


def write_json(value: object, path: Path) -> None:
    path.write_text(json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n", encoding="utf-8")


def files_digest(files: DataFrame) -> str:
    """SHA-256 over the distinct paths, in order, and contents of a binaryFile frame; contents are hashed by executors."""
    rows = files.select("path", F.sha2("content", 256).alias("digest")).distinct().orderBy("path")
    total = hashlib.sha256()
    for row in rows.toLocalIterator():
        total.update(row.path.encode() + b"\0" + row.digest.encode() + b"\0")
    return "sha256:" + total.hexdigest()


def tree_digest(spark: SparkSession, root: str, pattern: str = "*") -> str:
    """The digest of all files under root, at any depth, whose names fit the pattern; paths count from root on, empty files not at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    own = root.split(":", 1)[-1].strip("/")
    inside = F.col("path").substr(F.instr("path", own) + F.lit(len(own)), F.length("path"))
    return files_digest(files.withColumn("path", inside))


def winner_chart(won: DataFrame) -> DataFrame:
    """Bars of the winner chart, from the fewest wins up."""
    return study.winner_counts(won).orderBy("wins", "implementation")


def contrast_chart(pairs: DataFrame, question: str) -> DataFrame:
    """Points of a question's chart along its factor."""
    factor = {q[0]: q[3] for q in study.QUESTIONS}[question]
    return pairs.where(F.col("question") == question).select("case_name", "objective", F.col(factor).alias("factor"), "candidate_improvement_percent").orderBy("factor", "objective")


def charts(questions: tuple[tuple[str, ...], ...] = study.QUESTIONS) -> list[dict[str, str]]:
    """What each chart of a bundle shows: its data in charts.json, its kind, and the columns along its axes."""
    own = [{"chart": "latency_winner_counts", "kind": "bar", "x": "wins", "y": "implementation", "series": ""}]
    return own + [{"chart": q[0], "kind": "points", "x": "factor", "y": "candidate_improvement_percent", "series": "objective"} for q in questions]


def interval_chart(classified: DataFrame) -> DataFrame:
    """Points with error bars of a confirmatory experiment, the margins of its threshold, and a colour class each."""
    return classified.select("label", F.col("improvement_percent").alias("x"), "bar_below", "bar_above", (-F.col("threshold_percent")).alias("margin_low"), F.col("threshold_percent").alias("margin_high"), F.col("regression").alias("series")).orderBy("label")


def report(analysis: Analysis) -> str:
    """The findings in Markdown, from frames of study size."""
    audit = analysis.audit.first()
    leaders = study.winner_counts(analysis.winners).orderBy(F.desc("wins"), "implementation").limit(3).collect()
    lines = [
        "# Discovery report", "", "## Summary", "",
        f"The evidence is **{'formal-ready' if audit.formal_ready else 'exploratory only'}**: {audit.record_count} run-level records in {audit.cell_count} cells"
        f" from {'revision `' + audit.revisions[0] + '`' if len(audit.revisions) == 1 else 'several revisions'}.",
        "Most latency wins: " + (", ".join(f"`{r.implementation}` ({r.wins})" for r in leaders) or "none") + ".", "", "## Contrasts", "",
    ]
    for row in study.median_improvements(analysis.pairwise).orderBy("question").collect():
        lines.append(f"* `{row.question}`: the candidate improves by {row.median_improvement_percent:+.1f} % at the median of {row.contrasts} contrasts.")
    lines += ["", "## Limits", "", *([f"* {issue}." for issue in audit.issues] or ["* The evidence policy has no gaps."]), "", f"Input digest: `{analysis.input_digest}`.", ""]
    return "\n".join(lines)


def write_bundle(analysis: Analysis, output: str | Path) -> None:
    """Tables, analysis.json, chart data and the report in a new local folder."""
    folder = Path(output)
    if folder.exists():
        raise InvalidParameter(f"{folder} exists")
    folder.mkdir(parents=True)
    frames = {"measurements": analysis.records, "summary": analysis.summaries, "winners": analysis.winners, "pairwise": analysis.pairwise}
    for name, frame in frames.items():
        write_one_csv(frame, folder / f"{name}.csv", ORDERS[name])
    data = {"latency_winner_counts": [r.asDict() for r in winner_chart(analysis.winners).collect()]}
    data |= {q[0]: [r.asDict() for r in contrast_chart(analysis.pairwise, q[0]).collect()] for q in study.QUESTIONS}
    write_json(data | {"charts": charts()}, folder / "charts.json")
    counts = {name: frame.count() for name, frame in frames.items()}
    write_json({"schema_version": 1, "analysis_kind": "discovery", "input_digest": analysis.input_digest, "audit": analysis.audit.first().asDict(), "counts": counts, "questions": [q[0] for q in study.QUESTIONS]}, folder / "analysis.json")
    (folder / "report.md").write_text(report(analysis), encoding="utf-8")
