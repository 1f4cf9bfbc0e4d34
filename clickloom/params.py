"""Typed parameters of a job, decoded from a task's JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# Names of the parameters in a task's JSON.
NAMES = {
    "startDate": "start_date",
    "endDate": "end_date",
    "targetPageFlow": "page_flow",
    "startAge": "start_age",
    "endAge": "end_age",
    "professionals": "professionals",
    "cities": "cities",
    "sex": "sex",
    "keywords": "keywords",
    "categoryIds": "category_ids",
}
LISTS = ("page_flow", "professionals", "cities", "keywords", "category_ids")


@dataclass(frozen=True)
class Params:
    """None means that a filter is not given."""

    start_date: str | None = None
    end_date: str | None = None
    page_flow: tuple[int, ...] | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[str, ...] | None = None

    @classmethod
    def from_json(cls, text: str | None) -> Params:
        """All values are strings, lists comma-separated; blank values and unknown names are dropped."""
        raw = json.loads(text) if text and text.strip() else {}
        found: dict[str, object] = {}
        for name, value in raw.items():
            key = NAMES.get(name)
            if key is None or value is None or not str(value).strip():
                continue
            value = str(value).strip()
            if key in LISTS:
                parts = tuple(p.strip() for p in value.split(",") if p.strip())
                found[key] = tuple(map(int, parts)) if key == "page_flow" else parts
            else:
                found[key] = int(value) if key.endswith("age") else value
        return cls(**found)

    def to_json(self) -> str:
        back = {v: k for k, v in NAMES.items()}
        values = {back[f.name]: getattr(self, f.name) for f in fields(self)}
        return json.dumps({k: ",".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in values.items() if v is not None})
