"""Progress of an import, for display: estimates of events by bytes, fractions, short numbers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Estimator:
    """Events of a file from its bytes, by the bytes an event took in the files read so far (1500 before any)."""

    bytes_per_event: int = 1500
    events: int = 0
    size: int = 0

    def estimate(self, size: int) -> int:
        return 0 if size <= 0 else max(1, size // max(1, self.bytes_per_event))

    def observe(self, events: int, size: int) -> None:
        if events > 0 and size > 0:
            self.events, self.size = self.events + events, self.size + size
            self.bytes_per_event = max(1, self.size // self.events)


@dataclass
class Tracker:
    """Where an import of files (name -> bytes, in order) is: a file is never done before it is told so."""

    files: dict[str, int]
    estimator: Estimator = field(default_factory=Estimator)
    done: list[str] = field(default_factory=list)
    current: str = ""
    file_fraction: float = 0.0
    overall_fraction: float = 0.0

    def read(self, name: str, events: int) -> None:
        if name in self.files:
            expected = self.estimator.estimate(self.files[name])
            self.current, self.file_fraction = name, min(0.99, events / expected if expected else 0.0)
            self.overall_fraction = self._overall(self.file_fraction * self.files[name])

    def complete(self, name: str, events: int) -> None:
        if name in self.files:
            self.estimator.observe(events, self.files[name])
            self.done.append(name)
            self.current, self.file_fraction, self.overall_fraction = name, 1.0, self._overall(0.0)

    def _overall(self, more: float) -> float:
        total = sum(self.files.values())
        if total <= 0:
            return float(len(self.done) >= len(self.files))
        return min(1.0, max(0.0, (sum(self.files[n] for n in self.done) + more) / total))

    def text(self, **counts: int) -> str:
        head = f"[{list(self.files).index(self.current) + 1 if self.current else 0}/{len(self.files)}] {self.current}" if self.files else ""
        return f"{head}  file {percent(self.file_fraction)}%  overall {percent(self.overall_fraction)}%  " + " ".join(f"{k}={short(n)}" for k, n in counts.items())


def percent(fraction: float) -> int:
    return min(100, max(0, int(fraction * 100)))


def short(n: int) -> str:
    """Thousands as k, millions as M with one decimal, cut off and not rounded."""
    if n < 1000:
        return str(n)
    return f"{n // 1000}k" if n < 1_000_000 else f"{n // 100_000 // 10}.{n // 100_000 % 10}M"
