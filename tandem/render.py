"""Results as JSON lines and as text; every result is cut to its top rows before it comes here."""

from __future__ import annotations

import json

SHORT_REASONS = {"direct_cochange": "", "pagerank_direct_evidence": "ppr-direct", "pagerank_via_cochange_graph": "ppr", "path_name_baseline": "path", "hot_file_baseline": "hot"}


def escaped(text: str) -> str:
    """Control characters escaped, all others as they are."""
    return "".join(c.encode("unicode_escape").decode() if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in text)


def short_hash(text: str) -> str:
    return text[:12]


def as_json(value: dict) -> str:
    """One compact line; optional fields that are None are left out."""
    return json.dumps({k: v for k, v in value.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


def evidence_lines(rows: list[dict], indent: str = "  ") -> list[str]:
    return [f"{indent}- {short_hash(e['hash'])} {e['date']} files={e['file_count']} weight={e['weight']:.6f} {escaped(e['subject'])}" for e in rows]


def _hint_lines(hints: list[str]) -> list[str]:
    return [f"hint: {h}" for h in hints]


def query_text(target: str, mode: str, rows: list[dict], hints: list[str] = ()) -> str:
    """A header, then a line for each result, with counts where there are any and its evidence below."""
    lines = [f"related {escaped(target)} {escaped(mode)}"]
    if not rows:
        lines.append("no related files found")
    for i, r in enumerate(rows, 1):
        reason, together = r.get("reason", ""), r.get("cochanges", 0)
        line = f"{i} {escaped(r['path'])}" + (f" co={together}" if together else "")
        if not together or reason != "direct_cochange":
            line += f" s={r['score']:.3f}"
        if r.get("evidence"):
            line += (f" seen={r['last_seen']}" if r.get("last_seen") else "") + (f" w={r['weight']:.3f}" if r.get("weight", 0.0) > 0 else "")
        short = SHORT_REASONS.get(reason, reason)
        lines.append(line + (f" via={short}" if short else ""))
        lines += evidence_lines(r.get("evidence") or [])
    return "\n".join(lines + _hint_lines(hints))


def audit_text(value: dict) -> str:
    """The text of an audit's JSON value."""
    known, seeds = value["history_coverage"], value["seeds"]
    lines = [
        f"audit scope={escaped(value['scope'])} mode={escaped(value['mode'])} seeds={len(seeds)} minimum_confidence={value['minimum_confidence']} "
        f"backend={known['backend']} completeness={known['completeness']} rename_tracking={known['rename_tracking']}",
        f"changed {','.join(map(escaped, seeds))}",
    ]
    if value["abstained"]:
        lines.append("no candidates met the confidence threshold")
    for i, r in enumerate(value["candidates"], 1):
        lines.append(
            f"{i} {escaped(r['path'])} confidence={r['confidence']} support={r['support_count']}/{len(seeds)} co={r['cochanges']} "
            f"strongest_co={r['strongest_pair_cochanges']} s={r['score']:.3f}"
        )
        lines.append(f"  supported_by {','.join(map(escaped, r['supported_by']))}")
        lines += evidence_lines(r.get("evidence") or [])
    if e := value["enforcement"]:
        lines.append(f"enforcement threshold={e['threshold']} findings={e['finding_count']} triggered={str(e['triggered']).lower()} exit_code={e['exit_code']}")
    return "\n".join(lines + _hint_lines(value["hints"]))


def explain_text(r: dict) -> str:
    a, b = escaped(r["a"]), escaped(r["b"])
    if not r["related"]:
        return "\n".join([f"{a} and {b} have no direct co-change evidence in this history window.", *_hint_lines(r.get("hints", []))])
    lines = [f"{a} <-> {b}", f"cochanged={r['cochanges']} weight={r['weight']:.6f} last_seen={r['last_seen']}"]
    return "\n".join([*lines, *evidence_lines(r.get("evidence", []), ""), *_hint_lines(r.get("hints", []))])


def table_text(rows: list[dict], digits: int = 4) -> str:
    """Fixed-width columns; averages of counts with two digits, other fractions with four."""
    if not rows:
        return ""
    names = list(rows[0])
    show = lambda n, v: f"{v:.{2 if n.startswith('avg_') else digits}f}" if isinstance(v, float) else str(v)
    cells = [names, *([show(n, r[n]) for n in names] for r in rows)]
    width = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, width)).rstrip() for row in cells)
