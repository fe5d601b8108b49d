"""Images and source code."""

import numpy as np
import pytest

from skein.operators import raster
from skein.sources import code


def ppm(a):
    return (f"P3\n# made here\n{a.shape[1]} {a.shape[0]}\n255\n" + " ".join(map(str, a.ravel()))).encode()


def test_raster(spark):
    a = np.zeros((40, 60, 3), int)
    a[2:12, 30:58] = (255, 0, 0)
    a[30, 1] = (255, 0, 0)
    assert (raster.parse_ppm(ppm(a)) == a).all()
    with pytest.raises(ValueError):
        raster.parse_ppm(b"P6 1 1 255 0 0 0")
    d = raster.describe(spark.createDataFrame([(1, ppm(a)), (2, ppm(a * 0)), (3, None)], "image_id int, data binary"), {"red": (255, 0, 0)})
    r = raster.region(d).withColumn("wide", raster.is_wide()).collect()
    assert len(r) == 1 and (r[0].pixels, r[0].component, r[0].quadrant, r[0].x0, r[0].y1, r[0].region, r[0].wide) == (281, 280, "top-right", 30, 11, "top-right", True)


def test_components_touch_by_sides_only():
    m = np.array([[1, 0, 1], [0, 1, 1], [1, 1, 0]], bool)
    assert raster.largest_component(m)[0] == 5 and raster.largest_component(m & False)[0] == 0


def test_code(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('import json\nfrom pkg.b import helper\n\nclass Box:\n    """Holds things."""\n    def put(self, x):\n        return self.get(helper(x))\n    def get(self, x):\n        return json.dumps(x)\n')
    (tmp_path / "pkg" / "b.py").write_text("def helper(x):\n    return inner(x)\n\ndef inner(x):\n    return x\n")
    (tmp_path / "broken.py").write_text("def (")
    s = code.symbols(code.read(spark, str(tmp_path))).cache()
    assert {r.qualname: r.kind for r in s.collect()} == {"Box": "class", "Box.put": "method", "Box.get": "method", "helper": "function", "inner": "function"}
    g = {(r.caller.rpartition("::")[2], r.callee.rpartition("::")[2]) for r in code.call_graph(s).collect()}
    assert g == {("Box.put", "Box.get"), ("Box.put", "helper"), ("helper", "inner")}
    q = spark.createDataFrame([(0, "what does Box.put do"), (1, "inner")], "query_id int, text string")
    top = {(r.query_id, r.rank): r.symbol_id.rpartition("::")[2] for r in code.search(s, q, 3, code.call_graph(s)).collect()}
    assert top[0, 1] == "Box.put" and top[1, 1] == "inner" and top[1, 2] == "helper"
