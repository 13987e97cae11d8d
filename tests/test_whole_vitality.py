"""Vitality with every rule of bridges and with boosts, against brute force."""

import math
from datetime import datetime

import pytest

from notegraph.plans import catalog, notes
from notegraph.sources.vault import table

SF = "/root/testdata/sf0.001"
AS_OF = notes.AS_OF


def parts(edges, without=None):
    near = {}
    for a, b in edges:
        if without not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    left, n = set(near), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            todo += (new := near[todo.pop()] & left)
            left -= new
    return near, n


@pytest.fixture(scope="module")
def wanted(spark):
    edges = {(r.src, r.dst) for r in catalog.QUERIES["q_link_scan"](spark, SF).collect()}
    near, whole = parts({e for e in edges if e[0] != e[1]})
    # A node falls away with its neighbours that have no other link; each of them is a part of its own.
    cut = {v for v in near if parts(edges, v)[1] + sum(near[w] == {v} for w in near[v]) > whole}
    rows = table(spark, SF, "notes").collect()
    rest = {r.id for r in catalog.QUERIES["q_bridges"](spark, SF).where("reason <> 'articulation'").collect()}
    boosts = {r.title: r.boost for r in notes.boosts_table(spark, SF).collect()}
    indeg = {t: sum(b == t for _, b in edges) for t in {b for _, b in edges}}
    out, now = {}, datetime.fromisoformat(AS_OF)
    for r in rows:
        n, d, bridge, boost = r.access_count or 0, indeg.get(r.title, 0), r.title in cut | rest, boosts.get(r.title, 0.0)
        try:
            days = abs((now - datetime.strptime(r.created, "%Y-%m-%d")).total_seconds()) / 86400 if r.created else 0.0
        except ValueError:
            days = None
        base = 0.5 if n <= 0 else None if days is None else 1.0 if days <= 0 else 1 / (1 + math.exp(-(math.log(n / 0.5) - 0.5 * math.log(days))))
        v = None if base is None else base * (1 + 0.1 * min(d, 10)) * (0.5 + 0.5 * (1 - math.exp(-n / 10)))
        if v is not None:
            v = max(0.0, min(1.0, max(v + boost, 0.5) if bridge else v + boost))
        zone = "archived" if r.status == "archived" or v is None else "active" if v >= 0.6 else "stale" if v >= 0.3 else "fading" if v >= 0.1 else "archived"
        out[r.title] = (v, d, zone, bridge, r.status)
    assert cut - rest and boosts
    return out


def test_vitality_has_all_bridges_and_boosts(spark, wanted):
    found = {r.title: r for r in catalog.QUERIES["q_vitality"](spark, SF).collect()}
    assert {t: (None if v[0] is None else pytest.approx(v[0], abs=2e-6), v[1], v[2]) for t, v in wanted.items()} == {t: (r.vitality, r.in_degree, r.zone) for t, r in found.items()}


def test_pruning_spares_articulation_points(spark, wanted):
    found = {r.title for r in catalog.QUERIES["q_prune"](spark, SF).collect()}
    assert found == {t for t, (_, d, zone, bridge, status) in wanted.items() if (status or "") != "archived" and zone in ("fading", "archived") and not bridge and d < 2}
