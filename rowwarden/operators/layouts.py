"""The two fixed row layouts, and the names the rules use on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from rowwarden import fixed


@dataclass(frozen=True)
class Layout:
    name: str
    columns: tuple[tuple[str, str], ...]
    attributes: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(fixed.VOCABULARY))
    birthdate: str | None = "birthdate"
    placeholder: str | None = "others"
    none: str | None = "none_apply"
    person: str = "participant_name"
    email: str = "participant_email"

    @property
    def fields(self) -> list[str]:
        return [f for f, _ in self.columns]

    def header(self, name: str) -> str:
        return dict(self.columns)[name]

    def letter(self, name: str) -> str:
        return fixed.column_letter(self.fields.index(name))


CANONICAL = Layout("canonical", fixed.CANONICAL_COLUMNS)
DELIVERY = Layout("delivery", fixed.DELIVERY_COLUMNS)
