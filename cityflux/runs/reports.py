"""Text reports from a handful of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

_RULE = "-" * 60


def _few(df: DataFrame, most: int = 50) -> list[Row]:
    """Rows of a result known to be small; more than that is a mistake of the caller."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes at most {most} rows")
    return rows


def _section(title: str, lines: list[str]) -> list[str]:
    return [title, _RULE, *lines, ""]


def insight_report(info: DataFrame, findings: DataFrame, summary: DataFrame, title: str = "Traffic and air quality report") -> str:
    """Data set, key findings, index statistics."""
    i = _few(info)[0]
    out = _section(title.upper(), [])
    out += _section(
        "Data",
        [
            f"Records: {i['total_records']:,}",
            f"From {i['start']} to {i['end']}, {i['duration_days']} whole days",
            f"Locations: {i['locations']}",
        ],
    )
    ordered = sorted(_few(findings), key=lambda r: r["ord"])
    out += _section("Findings", [f"{n}. [{r['category']}] {r['finding']}" for n, r in enumerate(ordered, 1)])
    for r in _few(summary):
        if r["measure"] == "aqi_value" and r["mean"] is not None:
            out += _section(
                "Air quality index",
                [
                    f"Mean {r['mean']:.2f}, median {r['median']:.2f}, standard deviation {(r['std'] or 0.0):.2f}",
                    f"Range {r['min']:.0f} to {r['max']:.0f}",
                ],
            )
    return "\n".join(out)


def evaluation_report(metrics: DataFrame, model: str) -> str:
    """Metrics of one model, four places."""
    rows = sorted(_few(metrics), key=lambda r: r["metric"])
    lines = [f"{r['metric']}: {r['value']:.4f}" for r in rows if r["value"] is not None]
    return "\n".join(_section(f"MODEL EVALUATION: {model}", lines))


def summary_markdown(
    prepared: DataFrame, summary: DataFrame, findings: DataFrame, histories: list[DataFrame], metrics: dict[str, DataFrame],
    files: list[str], generated: str,
) -> str:
    """One page over the whole run."""
    p = _few(prepared)[0]
    out = ["# Analysis summary", "", f"As of {generated}", "", "## Preparation", ""]
    out += [
        f"- Records: {p['processed_records']:,} of {p['original_records']:,}",
        f"- Columns: {p['processed_features']}",
        f"- Range: {p['start']} to {p['end']}",
        "", "## Description", "",
    ]
    for r in _few(summary):
        if r["mean"] is not None:
            out.append(f"- {r['measure']}: mean {r['mean']:.2f}, median {r['median']:.2f}, {r['min']:.0f} to {r['max']:.0f}")
    out += [""] + [f"{r['ord']}. **{r['category']}** {r['finding']}" for r in sorted(_few(findings), key=lambda r: r["ord"])]
    out += ["", "## Models", ""]
    for history in histories:
        h = _few(history)[0]
        out.append(f"- {h['target']}: {h['model_type']}, {h['train_samples']:,} rows, {h['training_time']:.2f} s")
    for name, frame in metrics.items():
        out += ["", f"### {name}", ""]
        out += [f"- {r['metric']}: {r['value']:.4f}" for r in sorted(_few(frame), key=lambda r: r["metric"]) if r["value"] is not None]
    out += ["", "## Files", ""] + [f"- `{f}`" for f in files] + [""]
    return "\n".join(out)
