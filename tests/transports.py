"""Transports of services that misbehave, for the paged source. Their state is a folder, as tasks share nothing else."""

import os

from dossierflow.sources.paged import TryLater

GOOD = [{"id": f"m{k}", "at": f"2026-01-{k:02d}T08:00:00Z"} for k in range(1, 10)]


def _count(options, link):
    path = os.path.join(options["state"], link.replace("/", "_"))
    n = len(os.listdir(path)) if os.path.isdir(path) else 0
    os.makedirs(os.path.join(path, str(n)))
    return n


class Busy:
    """Asks to wait before the first `busy` answers of each page."""

    def __init__(self, options):
        self.options = options

    def fetch(self, link):
        if _count(self.options, link) < int(self.options["busy"]):
            raise TryLater(0.01)
        return {"value": GOOD[:2]}


class Circle:
    """Every page leads to the same next one."""

    def __init__(self, options):
        pass

    def fetch(self, link):
        return {"value": [GOOD[0] if link.endswith("=1") else GOOD[1]], "next": "circle"}


class Odd:
    """Items that are no messages between good ones."""

    def __init__(self, options):
        pass

    def fetch(self, link):
        return {"value": [{"id": None, "subject": "broken"}, GOOD[0], 7, {"id": "late", "at": "no date"}, GOOD[1]], "next": None}


class Endless:
    """Full pages without page numbers, the same ones again from the third on."""

    def __init__(self, options):
        pass

    def fetch(self, link):
        k = int(link.rpartition("=")[2])
        return {"value": GOOD[:2] if k % 2 else GOOD[2:4]}


class Long:
    def __init__(self, options):
        pass

    def fetch(self, link):
        k = int(link.rpartition("-")[2]) if "-" in link else 1
        return {"value": [{"id": str(k)}], "next": f"page-{k + 1}"}
