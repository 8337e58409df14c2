"""Translation behind a small protocol; the providers here need no network."""

from __future__ import annotations

from typing import Protocol


class Translator(Protocol):
    model: str

    def translate(self, text: str, target: str) -> str: ...


class SameText:
    """Gives every text back as it is."""

    model = "noop"

    def translate(self, text: str, target: str) -> str:
        return text


class Phrasebook:
    """Looks texts up in a table {(text, target): translation}; an unknown text is an error."""

    model = "phrasebook"

    def __init__(self, table: dict[tuple[str, str], str]) -> None:
        self.table = table

    def translate(self, text: str, target: str) -> str:
        return self.table[text, target]


class Remembered:
    """Asks another translator once for each (model, text, target), of the ``most`` last ones."""

    def __init__(self, inner: Translator, most: int = 10_000) -> None:
        self.inner, self.model, self.most = inner, inner.model, most
        self.known: dict[tuple[str, str, str], str] = {}

    def translate(self, text: str, target: str) -> str:
        key = self.model, text, target
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[key] = self.inner.translate(text, target)
        return self.known[key]


def translator(name: str, table: dict[tuple[str, str], str] | None = None) -> Translator:
    """The provider of a name; remote ones are not part of this engine."""
    if name == "noop":
        return Remembered(SameText())
    if name == "phrasebook":
        return Remembered(Phrasebook(table or {}))
    raise ValueError(f"no translation provider named {name!r}")


def fallback(text: str, found: tuple[str | None, float], provider: Translator, confident: float = 0.4, target: str = "en") -> str | None:
    """A query in the target language, if it is surely in another one and the provider can."""
    if found[0] is None or found[0] == target or found[1] < confident:
        return None
    try:
        return provider.translate(text, target)
    except Exception:  # noqa: BLE001  whatever a provider raises, the search goes on without it
        return None


def response_language(given: str | None, found: tuple[str | None, float], confident: float = 0.4) -> str | None:
    """The language to answer in: the given one, else the surely detected one, else none."""
    if given:
        return given
    return found[0] if found[0] and found[1] >= confident else None


def directive(language: str | None) -> str | None:
    return None if language is None else f"The evidence is in its own language; answer in '{language}'."
