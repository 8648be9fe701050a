"""The choices of one view: tag states and the weighted list of chosen tags, which parametrise the plans. Small by nature, so plain Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .view import TagStates

UNSELECTED, SELECTED, REQUIRED, FORBIDDEN, IMPLICIT = "unselected", "selected", "required", "forbidden", "implicit"
_LEFT = {SELECTED: UNSELECTED, REQUIRED: UNSELECTED, FORBIDDEN: UNSELECTED}
_RIGHT = {UNSELECTED: SELECTED, IMPLICIT: SELECTED, SELECTED: REQUIRED, REQUIRED: FORBIDDEN, FORBIDDEN: UNSELECTED}


@dataclass
class Session:
    """States by tag, and chosen tags with colour and weight: 1 where chosen outright, below 1 where related to one that is."""

    related: Callable[[str], list[tuple[str, float]]] = lambda tag: []
    palette: tuple[str, ...] = ("#1", "#2", "#3")
    states: dict[str, str] = field(default_factory=dict)
    chosen: dict[str, list] = field(default_factory=dict)  # tag: [colour, weight], in order
    excluded: set[str] = field(default_factory=set)  # related tags put aside until the choice changes

    def state(self, tag: str) -> str:
        return self.states.get(tag, UNSELECTED)

    def click(self, tag: str) -> str:
        return self.set_state(tag, _LEFT.get(self.state(tag), SELECTED))

    def right_click(self, tag: str) -> str:
        return self.set_state(tag, _RIGHT.get(self.state(tag), UNSELECTED))

    def set_state(self, tag: str, new: str) -> str:
        old = self.state(tag)
        self.states[tag] = new
        if old in (UNSELECTED, IMPLICIT) and new in (SELECTED, REQUIRED):
            self._choose(tag)
        elif old in (SELECTED, REQUIRED, FORBIDDEN) and new in (UNSELECTED, IMPLICIT):
            self._drop(tag)
        return new

    def _colour(self) -> str:
        used = {c for c, w in self.chosen.values() if w == 1.0}
        return next((c for c in self.palette if c not in used), self.palette[len(used) % len(self.palette)])

    def _choose(self, tag: str) -> None:
        if tag in self.chosen and self.chosen[tag][1] == 1.0:
            return
        colour = self._colour()
        self.chosen[tag] = [colour, 1.0]
        self._relate(tag, colour)

    def _relate(self, tag: str, colour: str) -> None:
        for other, weight in self.related(tag):
            if other in self.excluded:
                continue
            if other not in self.chosen:
                self.chosen[other] = [colour, weight]
            elif self.chosen[other][1] < weight and self.chosen[other][1] < 1.0:
                self.chosen[other][1] = weight

    def _drop(self, tag: str) -> None:
        """The tag goes; related tags are found anew from those left, which keep their colours."""
        self.chosen.pop(tag, None)
        self.chosen = {t: x for t, x in self.chosen.items() if x[1] == 1.0}
        for t, (colour, _) in list(self.chosen.items()):
            self._relate(t, colour)

    def exclude(self, tag: str) -> bool:
        """Puts a related tag aside; false if it is none."""
        if tag not in self.chosen or self.chosen[tag][1] == 1.0:
            return False
        self.excluded.add(tag)
        del self.chosen[tag]
        return True

    def clear_excluded(self) -> None:
        self.excluded.clear()

    def clear(self) -> None:
        self.excluded.clear()
        self.states.clear()
        self.chosen.clear()

    def weights(self, include_related: bool = True) -> dict[str, float]:
        """Chosen tags for the scores; forbidden ones are left out."""
        return {t: w for t, (_, w) in self.chosen.items() if self.state(t) != FORBIDDEN and (include_related or w == 1.0)}

    def tag_states(self) -> TagStates:
        by = lambda s: tuple(t for t, x in self.states.items() if x == s)
        return TagStates(by(SELECTED), by(REQUIRED), by(FORBIDDEN), tuple(t for t, (_, w) in self.chosen.items() if w < 1.0))
