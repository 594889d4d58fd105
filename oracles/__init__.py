"""Independent SQL answers, one text per query."""

from oracles import cleaning, features, learning, reports, sessions, streams


def texts() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (cleaning, features, reports, sessions, learning, streams):
        out |= module.TEXTS
    return out
