"""Passes of fits that run side by side over the same blocks, made as one.

A fit asks for its sums one after the other, and waits for each. Fits in threads of their own on the same blocks wait here
until all of them have asked; then one pass reads every block once and adds up what each has asked for. What several would
ask for is asked for by one of them (``claim``), the others wait for its answer.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pulsegrid.models.blocks import Pieces, StoredBlocks, fold_blocks, fold_several


class _Asked:
    def __init__(self, work: Callable[[Any], Any], add: Callable[[Any, Any], Any], pieces: Pieces | None):
        self.how = work, add, pieces
        self.done = False
        self.found: Any = None
        self.error: BaseException | None = None


class Passes:
    """The passes over the blocks of a store. A fit is a member while it runs; one that does not ask holds up the others."""

    def __init__(self, stored: StoredBlocks):
        self.blocks, self.tasks = stored.blocks, stored.tasks
        self.ready = threading.Condition()
        self.members, self.running = 0, False
        self.asked: list[_Asked] = []
        self.claimed: set[Hashable] = set()
        self.waiters: list[tuple[set, threading.Event]] = []

    @contextmanager
    def member(self) -> Iterator[None]:
        with self.ready:
            self.members += 1
        try:
            yield
        finally:
            with self.ready:
                self.members -= 1
                self.ready.notify_all()

    def _complete(self) -> bool:
        return not self.running and len(self.asked) + len(self.waiters) >= self.members

    def fold(self, work: Callable[[Any], Any], add: Callable[[Any, Any], Any], pieces: Pieces | None = None) -> Any:
        """As ``StoredBlocks.fold``; the last to ask makes the pass for all."""
        mine = _Asked(work, add, pieces)
        with self.ready:
            self.asked.append(mine)
            self.ready.notify_all()
        while True:
            with self.ready:
                self.ready.wait_for(lambda: mine.done or self._complete())
                if mine.done:
                    break
                batch, self.asked, self.running = self.asked, [], True
            try:
                for one, found in zip(batch, self._pass([one.how for one in batch])):
                    one.found = found
            except BaseException as error:
                for one in batch:
                    one.error = error
            with self.ready:
                for one in batch:
                    one.done = True
                self.running = False
                self.ready.notify_all()
        if mine.error is not None:
            raise mine.error
        return mine.found

    def _pass(self, asked: Sequence[tuple]) -> list:
        if len(asked) == 1:
            return [fold_blocks(self.blocks, self.tasks, *asked[0])]
        return fold_several(self.blocks, self.tasks, asked)

    def claim(self, keys: Sequence[Hashable]) -> list:
        """Those of the keys that nobody else is finding out; they are the caller's until it settles them."""
        with self.ready:
            mine = [key for key in keys if key not in self.claimed]
            self.claimed.update(mine)
            return mine

    def settle(self, keys: Sequence[Hashable]) -> None:
        with self.ready:
            self.claimed.difference_update(keys)
            for waiter in [w for w in self.waiters if not w[0].isdisjoint(keys)]:
                self.waiters.remove(waiter)
                waiter[1].set()
            self.ready.notify_all()

    def wait_for_others(self, keys: Sequence[Hashable]) -> None:
        """Until one that has claimed some of the keys has settled them."""
        settled = threading.Event()
        with self.ready:
            if self.claimed.isdisjoint(keys):
                return
            self.waiters.append((set(keys), settled))
            self.ready.notify_all()
        settled.wait()
