"""A small task graph: each task once, in order, and only when there is work."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable


@dataclasses.dataclass
class _Task:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...]
    dirty: Callable[[dict], bool] | None = None
    iterate: bool = False


class TaskGraph:
    """Tasks with what they need, a rule for whether there is work, and a runner."""

    def __init__(self, most_rounds: int = 20):
        self.tasks: dict[str, _Task] = {}
        self.most_rounds = most_rounds

    def task(self, *needs: str, name: str | None = None, iterate: bool = False):
        """Register a function; ``iterate`` lets it run again while it is dirty."""

        def add(fn):
            n = name or fn.__name__
            if n in self.tasks:
                raise ValueError(f"task {n} exists")
            self.tasks[n] = _Task(n, fn, needs, iterate=iterate)
            return fn

        return add

    def dirty(self, name: str):
        """Register the rule of a task; without one a task always has work."""

        def add(fn):
            if name not in self.tasks:
                raise ValueError(f"no task {name}")
            self.tasks[name].dirty = fn
            return fn

        return add

    def order(self, target: str) -> list[str]:
        """What ``target`` needs, before it, then itself; a circle is an error."""
        done: list[str] = []
        open_: list[str] = []

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_:
                raise ValueError("circle: " + " > ".join([*open_[open_.index(n) :], n]))
            if n not in self.tasks:
                raise ValueError(f"no task {n}")
            open_.append(n)
            for m in self.tasks[n].needs:
                visit(m)
            done.append(open_.pop())

        visit(target)
        return done

    def run(self, target: str, ctx: dict | None = None, force: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
        """Run what is dirty or forced; returns the names that ran, in order. The order is
        walked again until a walk runs nothing, so that an iterating task sees what later
        ones did; other tasks run once, and forced ones whatever their rule says."""
        ctx, force, exclude, ran = ctx if ctx is not None else {}, set(force), set(exclude), []
        if unknown := sorted((force | exclude) - set(self.tasks)):
            raise ValueError(f"no task {', '.join(unknown)}")
        order = [n for n in self.order(target) if n not in exclude]
        for _ in range(self.most_rounds):
            before = len(ran)
            for n in order:
                t = self.tasks[n]
                again = n in ran
                if again and not t.iterate:
                    continue
                forced = n in force and not again
                has_work = t.dirty(ctx) if t.dirty is not None else not again
                if forced or has_work:
                    t.run(ctx)
                    ran.append(n)
            if len(ran) == before:
                return ran
        raise RuntimeError(f"{target} does not settle")
