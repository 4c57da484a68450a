"""Scope lookup: each step wins somewhere, against a walk for each site."""

import random

import pytest

from codeloom.operators import resolution, scopes

PRIORITY = resolution.ORIGIN_PRIORITY


def walk(site, parent, bindings, defs, receivers, mro):
    """The seven steps for one site, one scope after the other."""
    def up(scope):
        while scope is not None:
            yield scope
            scope = parent.get(scope)

    found, shadowed, asked = {}, False, site["name"]
    for depth, s in enumerate(up(site["scope"])):
        here = [b for b in bindings if b["scope"] == s and b["name"] == asked]
        if here:
            shadowed = True
            for b in here:
                if defs[b["id"]]["kind"] in site["kinds"]:
                    found[b["id"]] = {"step": 1, "origin": b["origin"], "depth": depth, "linked": b["linked"]}
            break
    if site["by_receiver"]:
        for r in [site["receiver"]] if site["receiver"] else ["self", "this"]:
            t = next((x["type"] for s in up(site["scope"]) for x in receivers if (x["scope"], x["receiver"]) == (s, r)), None)
            classes = [i for i, d in defs.items() if d["qualified"] == t and t is not None]
            if len(classes) == 1:
                for m, cls in enumerate([classes[0], *mro.get(classes[0], [])]):
                    for i, d in defs.items():
                        if d["owner"] == cls and d["qualified"].split(".")[-1] == asked and d["kind"] in site["kinds"]:
                            c = found.setdefault(i, {"step": 2, "origin": None})
                            c["mro"] = min(m, c.get("mro", 99))
                            c["own"] = c.get("own") or cls == classes[0]
                break
    for i, d in defs.items():
        if site["owner"] and d["owner"] == site["owner"] and d["qualified"].split(".")[-1] == asked and d["kind"] in site["kinds"]:
            found[i] = found.get(i, {}) | {"step": 3, "origin": "local", "depth": 0, "own": True}
    for i, c in found.items():
        d = defs[i]
        c["fits"] = None if site["arg_count"] is None or d["total"] is None else (d["required"] if d["required"] is not None else d["total"]) <= site["arg_count"] <= d["total"]
    if site["arg_count"] is not None:
        verdicts = [c["fits"] for c in found.values()]
        found = {i: c for i, c in found.items() if (c["fits"] is not False if True in verdicts else None in verdicts)}
    if not found and not shadowed and "." in asked:
        found = {i: {"step": 6, "origin": "global-qualified"} for i, d in defs.items() if d["qualified"] == asked and d["kind"] in site["kinds"]}
    out = []
    for i, c in found.items():
        score = resolution.ORIGIN_WEIGHT.get(c["origin"], 0.0) * (1 if c.get("linked", True) else 0.5) - 0.02 * c.get("depth", 0)
        score += resolution.MRO_WEIGHT[min(c["mro"], 4)] if "mro" in c else 0.0
        score += (0.2 if c.get("own") else 0.0) + {None: 0.0, True: 0.1, False: -0.15}[c.get("fits")]
        out.append((-round(max(0.0, min(1.0, score)), 3), c.get("depth", 0), c.get("mro", 0), PRIORITY[c["origin"] or "import"], i, c["step"]))
    return [(k[4], k[5]) for k in sorted(out)]


SITES = "site int, scope int, name string, kinds array<string>, receiver string, by_receiver boolean, owner string, arg_count int"


def made(rng):
    parent = {s: (None if s == 0 else rng.randrange(max(0, s - 4), s)) for s in range(40)}
    kinds = ["Function", "Method", "Class"]
    defs = {f"t{j}": {"kind": "Class", "qualified": f"T{j}", "owner": None, "required": None, "total": None} for j in range(4)}
    defs["t3b"] = {**defs["t3"]} if rng.random() < 0.3 else {**defs["t3"], "qualified": "Other"}
    for i in range(60):
        owner = rng.choice([None, "t0", "t1", "t2", "t3"])
        total = rng.choice([None, 0, 1, 2])
        q = rng.choice(["f", "g", "h"])
        defs[f"d{i:02}"] = {"kind": rng.choice(kinds), "qualified": (f"pkg.{q}" if owner is None else f"T.{q}"), "owner": owner, "required": None if total is None else rng.randrange(total + 1), "total": total}
    bindings = [{"scope": rng.randrange(40), "name": rng.choice(["f", "g", "h"]), "id": f"d{rng.randrange(60):02}", "origin": rng.choice(["local", "import", "wildcard"]), "linked": rng.random() < 0.8} for _ in range(14)]
    bindings = list({(b["scope"], b["name"], b["id"]): b for b in bindings}.values())
    receivers = list({(s, r): {"scope": s, "receiver": r, "type": f"T{rng.randrange(5)}"} for s, r in [(rng.randrange(40), rng.choice(["self", "this", "x"])) for _ in range(15)]}.values())
    mro = {"t3": ["t2", "t1"], "t2": ["t1", "t0"], "t1": ["t0"]}
    sites = [(i, rng.randrange(40), rng.choice(["f", "g", "h", "pkg.f", "pkg.g", "pkg.none"]), rng.sample(kinds, 2), rng.choice([None, None, "x"]), rng.random() < 0.5, rng.choice([None, None, "t1", "t2"]), rng.choice([None, 0, 1, 2, 3])) for i in range(120)]
    return parent, defs, bindings, receivers, mro, sites


def frames(spark, parent, defs, bindings, receivers, mro, sites):
    return (
        spark.createDataFrame(sites, SITES), spark.createDataFrame(list(parent.items()), "scope int, parent int"),
        spark.createDataFrame([(b["scope"], b["name"], b["id"], b["origin"], b["linked"]) for b in bindings], "scope int, name string, id string, origin string, linked boolean"),
        spark.createDataFrame([(i, d["kind"], d["qualified"], d["owner"], d["required"], d["total"]) for i, d in defs.items()], "id string, kind string, qualified string, owner string, required int, total int"),
        spark.createDataFrame([(r["scope"], r["receiver"], r["type"]) for r in receivers], "scope int, receiver string, type string"),
        spark.createDataFrame([(c, p, a) for c, order in mro.items() for p, a in enumerate(order)], "child string, pos int, ancestor string"),
    )


def test_lookup_equals_a_walk_for_each_site(spark):
    steps = set()
    for seed in (1, 2):
        parts = made(random.Random(seed))
        got = {}
        for r in scopes.lookup(*frames(spark, *parts)).orderBy("site", "rank").collect():
            got.setdefault(r["site"], []).append((r["id"], r["step"]))
        parent, defs, bindings, receivers, mro, sites = parts
        names = [x.split()[0] for x in SITES.split(", ")]
        for row in sites:
            want = walk(dict(zip(names, row)), parent, bindings, defs, receivers, mro)
            assert got.get(row[0], []) == want, row
            steps |= {s for _, s in want[:1]}
    assert steps == {1, 2, 3, 6}


def test_enclosing_scopes(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "scope int, parent int")
    assert {(r["scope"], r["outer"], r["depth"]) for r in scopes.enclosing(chain).collect()} == {(i, j, i - j) for i in range(70) for j in range(i + 1)}
    for circle in ([(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3)]):
        with pytest.raises(ValueError):
            scopes.enclosing(spark.createDataFrame(circle, "scope int, parent int"))
