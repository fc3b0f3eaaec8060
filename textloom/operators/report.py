"""Markdown reports from small collected tables: number formats, tables, marked blocks in a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

MISSING = "—"


def decimals(x, digits: int = 2) -> str:
    return MISSING if x is None else f"{float(x):.{digits}f}"


def percent(x, of_one: bool = False) -> str:
    return MISSING if x is None else f"{float(x) * (100 if of_one else 1):.1f}%"


def rate(x) -> str:
    """A share of one, as the analysis prints it."""
    return "n/a" if x is None else f"{x * 100:.1f}%"


def thousands(x) -> str:
    return MISSING if x is None else f"{round(float(x)):,}"


def whole(x) -> str:
    return MISSING if x is None else str(int(x))


def signed(x, digits: int = 2) -> str:
    return MISSING if x is None else f"{float(x):+.{digits}f}"


def p_value(p: float, samples: int) -> str:
    """Below what that many samples can tell, it is only known to be less."""
    return f"<{1 / samples:.3f}" if p < 1 / samples else f"{p:.3f}"


def cell(text) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def table(head: Sequence[str], rows: Sequence[Sequence], source: str | None = None) -> str:
    lines = ["| " + " | ".join(map(cell, head)) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(map(cell, row)) + " |" for row in rows]
    return "\n".join([*lines, *([] if source is None else ["", f"*Source: {source}*"])])


def or_placeholder(paths: Sequence[str], make: Callable[[], str]) -> str:
    """What make returns, or one line that names the first path that is missing."""
    for path in paths:
        if not Path(path).exists():
            return f"_(not available: {path} missing)_"
    return make()


_BEGIN = re.compile(r"<!--\s*BEGIN:([\w.-]+)\s*-->")


def render(text: str, tables: Mapping[str, Callable[[], str]]) -> str:
    """The text with each block between the marks BEGIN:name and END:name replaced by that table.

    A name that is unknown or comes twice is an error; all else stays as it is, and rendering again changes nothing.
    """
    names = _BEGIN.findall(text)
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"marks that come twice: {twice}")
    if unknown := [n for n in names if n not in tables]:
        raise ValueError(f"unknown marks: {unknown}")
    for name in names:
        block = re.compile(rf"(<!--\s*BEGIN:{re.escape(name)}\s*-->).*?(<!--\s*END:{re.escape(name)}\s*-->)", re.DOTALL)
        body = tables[name]()
        text = block.sub(lambda m, body=body: f"{m[1]}\n{body}\n{m[2]}", text, count=1)
    return text


def build(path: str, tables: Mapping[str, Callable[[], str]]) -> str:
    """Renders a file in place."""
    out = render(Path(path).read_text(encoding="utf-8"), tables)
    Path(path).write_text(out, encoding="utf-8")
    return out


def histogram_lines(counts: Sequence[int], width: int = 40) -> str:
    """A line for each bin of [0, 1), with a bar in proportion to the largest."""
    most, step = max(counts, default=0) or 1, 1 / max(1, len(counts))
    bars = ["#" * max(1, round(width * n / most)) if n else "" for n in counts]
    return "\n".join(f"[{k * step:.1f},{(k + 1) * step:.1f}) {n:5d} {bar}" for k, (n, bar) in enumerate(zip(counts, bars, strict=True))) if any(counts) else "(no scores)"


def fidelity_table(rows: Sequence[Mapping], labels: Mapping[str, str] = {}) -> str:  # noqa: B006
    """Collected rows of fidelity, those of all categories together."""
    head = ("System", "Numbers", "Citations", "Terms (any/ref)", "Repetition", "Omission", "Addition", "Mean length ratio")
    body = [(labels.get(r["system"], r["system"]), rate(r["number_rate"]), rate(r["citation_rate"]), f"{rate(r['hit_any_rate'])}/{rate(r['hit_ref_rate'])}", r["repetition"], r["omission"], r["addition"], decimals(r["mean_length_ratio"] or 0.0)) for r in rows if r["category"] is None]
    return table(head, body)


def scores_table(rows: Sequence[Mapping]) -> str:
    """Collected rows of evaluate."""
    return table(("System", "Segments", "BLEU", "chrF++"), [(r["label"], whole(r["n"]), decimals(r["bleu"]), decimals(r["chrf"])) for r in rows])


def significance_table(rows: Sequence[Mapping], samples: int) -> str:
    return table(("A", "B", "Metric", "Delta", "95 % interval", "p"), [(r["a"], r["b"], r["metric"], signed(r["delta"]), f"[{signed(r['ci95'][0])}, {signed(r['ci95'][1])}]", p_value(r["p_value"], samples)) for r in rows])


def outcome_table(rows: Sequence[Mapping]) -> str:
    """Collected rows of outcome_counts."""
    return table(("Comparison", "Kind", "Name", "Win", "Tie", "Loss"), [(f"{r['b']} vs {r['a']}", r["kind"], r["name"], r["win"], r["tie"], r["loss"]) for r in rows])


def robustness_table(rows: Sequence[Mapping]) -> str:
    systems = sorted({r["system"] for r in rows})
    by = {(r["min_words"], r["system"]): r for r in rows}
    steps = sorted({r["min_words"] for r in rows})
    return table(("Words at least", "Segments", *systems), [(n, max(by[n, s]["n"] for s in systems if (n, s) in by), *(decimals(by[n, s]["chrf"]) if (n, s) in by else MISSING for s in systems)) for n in steps])


def documents_table(rows: Sequence[Mapping]) -> str:
    """Collected rows of alignment_stats for documents."""
    return table(("Document", "Source", "Target", "Kept", "Dropped"), [(r["doc"], whole(r["n_src"]), whole(r["n_tgt"]), whole(r["n_kept"]), whole(sum((r["dropped"] or {}).values()))) for r in rows if r["doc"] is not None])


def examples(curated: Sequence[Mapping], records: Mapping[str, Mapping], covered: Mapping[str, Sequence[int]], baseline: str, adapted: str) -> str:
    """Curated examples (pair_id, categories, analysis) with their records, after the table of categories."""
    out = [table(("Category", "Examples"), [(c, ", ".join(f"#{n}" for n in numbers)) for c, numbers in covered.items()]), ""]
    for k, chosen in enumerate(curated, 1):
        r = records[chosen["pair_id"]]
        texts = (("Source", r["src"], ""), ("Reference", r["ref"], ""), (f"Baseline ({baseline})", r["baseline"], decimals(r["score_baseline"], 1)), (f"Adapted ({adapted})", r["adapted"], decimals(r["score_adapted"], 1)))
        out += [f"### Example {k}: {', '.join(chosen['categories'])}", "", table(("", "Text", "chrF++"), texts), "", str(chosen.get("analysis", "")).strip(), ""]
    return "\n".join(out)
