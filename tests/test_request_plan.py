"""The whole request path against a plain Python walk over the same rows."""

import math

from civicgraph.operators import lookup as L
from civicgraph.operators import textrules as X
from civicgraph.plans import QUERIES
from civicgraph.sources.fixtures import view


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 3959 * 2 * math.asin(math.sqrt(h))


def place_of(lat, lon):
    for cond, code in L.BOROUGH_BOXES:
        if eval(cond.format(lat=lat, lon=lon).replace("AND", "and")):
            return code
    return min(L.BOROUGH_CENTROIDS, key=lambda b: math.hypot(lat - L.BOROUGH_CENTROIDS[b][0], lon - L.BOROUGH_CENTROIDS[b][1]))


def search(mart, types, top, borough, spot):
    kinds = {t for x in types for t in L.TYPE_EXPANSION.get(x, [x])}
    rows = [r for r in mart if r.resource_type in kinds]
    if spot:
        rows = [r for r in rows if r.borough == place_of(spot.lat, spot.lon)] or rows
        rows.sort(key=lambda r: (miles(spot.lat, spot.lon, r.latitude, r.longitude), r.resource_id))
    else:
        rows = [r for r in rows if borough is None or r.borough == borough]
        rows.sort(key=lambda r: (-r.safety_score, -r.quality_score, r.resource_id))
    return [r.name for r in rows[:top]]


def pick(category, found):
    kinds = L.TYPE_EXPANSION.get(category, [category])
    for fits in (lambda k: k == category, lambda k: any(t in k for t in kinds), lambda k: category in k or k in category):
        hit = next((names for k, names in found if names and fits(k)), None)
        if hit:
            return hit
    return []


def test_request_plan_equals_a_plain_walk(spark, sf_dir):
    mart = view(spark, sf_dir, "mart").collect()
    asked = X.intent_rules(view(spark, sf_dir, "requests").where(X.screen_reason("text").isNull()))
    asked = asked.where("intent = 'needs_assessment'").withColumn("spot", X.landmark_geocode()).collect()
    want = {}
    for r in asked:
        found = [("+".join(s.types), search(mart, s.types, s.top, r.borough, r.spot)) for s in r.searches]
        for n in r.needs:
            names = pick(n.category, found)
            want[(r.request_id, n.category)] = (names[0] if names else None, "; ".join(names[1:4]))
    got = {(r.request_id, r.category): (r.top_resource, r.alternatives)
           for r in QUERIES["request_plan"](spark, sf_dir).collect()}
    assert got == want and len(got) > 50
