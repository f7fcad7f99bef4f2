"""A plain best-fit-decreasing packer."""

import random

from tidelog.llm.packing import best_fit_decreasing


def best_fit(lengths, window):
    """How many windows it takes: the longest first, each into the window that it leaves least room in."""
    rooms = []
    for need in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= need]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= need
        else:
            rooms.append(window - need)
    return len(rooms)


def test_as_many_windows_as_the_plain_one():
    rng = random.Random(1)
    for _ in range(50):
        window = rng.choice([7, 64, 2048])
        lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 120))]
        assert len(set(best_fit_decreasing(lengths, window)[0])) == best_fit(lengths, window)
