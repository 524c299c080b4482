"""Collections cut anywhere must give what a plain JSON parser gives."""

import json
import random

import pytest

from pedalgrid.sources import readers


N = 14


def feature(i, rng):
    line = [[rng.random(), i] for _ in range(rng.randint(2, 9))]
    odd = rng.choice(["plain", 'a "quoted" }{ ][ text', "back\\slash\\", "}", '"', "tab\té"])
    out = {"properties": {"id": str(i), "odd": odd, "deep": {"a": [{"b": [1, {"c": odd}]}]}}, "geometry": {"type": "LineString", "coordinates": line}}
    return {"type": "Feature", **out} if rng.random() < 0.5 else {**out, "type": "Feature"}


def written(folder, rng):
    """Files of all layouts; the ids that each holds, or as many as can be read."""
    want = {}

    def put(name, text, ids):
        (folder / f"{name}.geojson").write_text(text, encoding="utf-8")
        want[name] = sorted(map(str, ids))

    fs = [feature(i, rng) for i in range(N)]
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x }"}}}
    put("one_line", json.dumps({**head, "features": fs}), range(N))
    put("indented", json.dumps({**head, "features": fs}, indent=2), range(N))
    put("tail", json.dumps({"features": fs, **head, "links": [{"href": "x"}, {"href": "]"}]}, indent=1), range(N))
    put("by_line", "\n".join(json.dumps(f) for f in fs) + "\n", range(N))
    put("mixed", '{"features": [\n' + json.dumps(fs[0]) + ",\n" + ",\n".join(json.dumps(f, indent=3) for f in fs[1:]) + "\n]}", range(N))
    put("two_a_line", json.dumps(head)[:-1] + ', "features": [' + ",".join(json.dumps(f, ensure_ascii=False) for f in fs) + "]}\n", range(N))
    put("own", json.dumps(fs[7], indent=4), [7])
    put("many_collections", "\n".join(json.dumps({**head, "features": fs[k : k + 5]}) for k in range(0, N, 5)), range(N))
    put("empty_list", json.dumps({**head, "features": []}), [])
    put("nothing", " \n", [])
    whole = json.dumps({**head, "features": fs})
    put("cut", whole[: whole.index(json.dumps(fs[N - 4])) + 40], range(N - 4))
    put("garbled", json.dumps({**head, "features": fs}).replace('"id": "5"', '"id": 5 5'), [i for i in range(N) if i != 5])
    return want


@pytest.mark.parametrize("block", [701, 128 << 20])
def test_any_layout_in_any_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    want = written(tmp_path, rng)
    sizes = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        found = {name: [] for name in want}
        odd = {}
        for r in readers.geojson_features(spark, str(tmp_path)).collect():
            found[r["file"]].append(r["properties"]["id"])
            odd[r["file"], r["properties"]["id"]] = r["properties"]["odd"], r["kind"], json.loads(r["coordinates"])
        assert {k: sorted(v) for k, v in found.items()} == want
        rng = random.Random(block)
        for i, f in enumerate(feature(i, rng) for i in range(N)):
            for name in ("indented", "mixed", "two_a_line"):
                assert odd[name, str(i)] == (f["properties"]["odd"], "LineString", f["geometry"]["coordinates"])
        bad = {r["file"]: r["reason"] for r in readers.unreadable_geojson(spark, str(tmp_path)).collect()}
        assert bad == {"empty_list": "no_features", "nothing": "no_features", "cut": "broken", "garbled": "broken"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
