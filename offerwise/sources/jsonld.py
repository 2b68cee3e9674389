"""JSON-LD blocks -> offer nodes in breadth-first order."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date spellings accepted beside ISO 8601.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d")


def _text(value: object) -> str:
    """A scalar as text; '' for what counts as empty."""
    if value is None or value is False or value == "" or value == 0:
        return ""
    if value is True:
        return "true"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    # half of a surrogate pair, as in a cut emoji, has no UTF-8 form
    return text.encode("utf-8", "replace").decode("utf-8")


def block_nodes(raw: str) -> Iterator[dict]:
    """Objects of one block that carry a name, description or code, breadth first.

    Raises RecursionError where the block is nested deeper than the JSON reader goes.
    """
    try:
        queue = deque([json.loads(raw)])
    except ValueError:
        return
    visit = 0
    while queue:
        visit += 1
        current = queue.popleft()
        if isinstance(current, list):
            queue.extend(current)
        elif isinstance(current, dict):
            queue.extend(v for v in current.values() if isinstance(v, (dict, list)))
            code = current.get("couponCode")
            code = current.get("discountCode") if code is None else code
            named = [_text(current.get(k)) for k in ("name", "description")]
            description = " - ".join(t for t in named if t)
            if description or _text(code):
                until = current.get("validThrough")
                until = current.get("priceValidUntil") if until is None else until
                yield {
                    "visit": visit,
                    "text": description,
                    "code": _text(code) or None,
                    "valid_through": _text(until) if isinstance(until, str) else None,
                }


def published_date(text: Column) -> Column:
    """ISO date or timestamp, or one of the known spellings; null otherwise."""
    parsed = [text.try_cast("timestamp")]
    parsed += [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*parsed)
