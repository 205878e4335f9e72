"""Texts of alerts from check results; nothing is sent from here."""

from __future__ import annotations

from collections.abc import Callable

from .scalars import STATUS_ORDER

LINES, KEYS, LENGTH = 8, 3, 3800


def problems(rows: list[dict]) -> list[dict]:
    """Results that aren't ok, the worst first."""
    bad = [r for r in rows if r["status"] != "ok"]
    return sorted(bad, key=lambda r: (-STATUS_ORDER.index(r["status"]), r["check_name"], r.get("table_name", "")))


def alert_text(job: str, run: str, rows: list[dict]) -> str:
    """A heading, at most ``LINES`` problems with at most ``KEYS`` keys each, cut to ``LENGTH`` characters."""
    bad = problems(rows)
    lines = [f"{job}: {len(bad)} problem{'s' * (len(bad) != 1)} in {run}"]
    for r in bad[:LINES]:
        keys = ", ".join(map(str, r.get("sample_keys", [])[:KEYS]))
        lines.append(f"- {r['status']}: {r['check_name']} ({r.get('table_name', '')}), {r.get('violations', 0)}" + (f": {keys}" if keys else ""))
    if len(bad) > LINES:
        lines.append(f"and {len(bad) - LINES} more")
    text = "\n".join(lines)
    return text if len(text) <= LENGTH else text[: LENGTH - 1] + "…"


def with_retry(send: Callable[[str], int | None], text: str) -> bool:
    """Tries once more after a network error or an answer of 429 or 5xx; true if it was taken."""
    for _ in range(2):
        try:
            code = send(text)
        except OSError:
            continue
        if code is None or code < 400:
            return True
        if code != 429 and code < 500:
            return False
    return False


def probe(send: Callable[[str], int | None], text: str = "channel probe") -> dict:
    """A result row that tells whether the channel takes a message: ``ok`` or ``error``."""
    taken = with_retry(send, text)
    return {"check_name": "alert_channel", "table_name": "", "status": "ok" if taken else "error", "violations": int(not taken), "error": None if taken else "the channel took no message"}
