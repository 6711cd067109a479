"""The same scene as PPM, PNG and JPEG."""

import math

import pytest

from plotlink.sources import images


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    """A soft 40 x 30 scene in each format, and a file that is no picture."""
    folder = tmp_path_factory.mktemp("pictures")
    w, h = 40, 30
    rgb = [[(int(120 + 100 * math.sin(x / 9)), int(120 + 100 * math.cos(y / 7)), int(3 * x + 2 * y)) for x in range(w)] for y in range(h)]
    (folder / "scene.ppm").write_bytes(b"P6\n%d %d\n255\n" % (w, h) + bytes(v for row in rgb for p in row for v in p))
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)  # TYPE_INT_RGB
    gray = jvm.java.awt.image.BufferedImage(w, h, 10)  # TYPE_BYTE_GRAY
    for y in range(h):
        for x in range(w):
            r, g, b = rgb[y][x]
            picture.setRGB(x, y, (r << 16) | (g << 8) | b)
            gray.getRaster().setSample(x, y, 0, r)
    for name in ("png", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(picture, name, jvm.java.io.File(str(folder / f"scene.{name}")))
    assert jvm.javax.imageio.ImageIO.write(gray, "png", jvm.java.io.File(str(folder / "gray.png")))
    (folder / "broken.png").write_bytes(b"\x89PNG no more")
    return folder, rgb


def fetch(spark, folder, names):
    rows = [(k, f"file://{folder}/{n}", 10.0, 50.0, 30.0) for k, n in enumerate(names)]
    got = images.fetched(spark.createDataFrame(rows, "id long, url string, x0 double, y1 double, x1 double")).collect()
    return {names[r.id]: r for r in got}


def test_formats_agree(spark, pictures):
    folder, rgb = pictures
    luma = [0.299 * r + 0.587 * g + 0.114 * b for row in rgb for r, g, b in row]
    got = fetch(spark, folder, ["scene.ppm", "scene.png", "scene.jpg", "gray.png", "broken.png", "missing.png"])
    assert len(got) == 6
    for name, most in (("scene.ppm", 1e-9), ("scene.png", 1e-9), ("scene.jpg", 12.0)):
        r = got[name]
        assert (r.w, r.h, r.min_x, r.max_y, r.res, r.error) == (40, 30, 10.0, 50.0, 0.5, None)
        assert max(abs(a - b) for a, b in zip(r.gray, luma, strict=True)) <= most
    assert list(got["gray.png"].gray) == [float(r) for row in rgb for r, _, _ in row]
    for name in ("broken.png", "missing.png"):
        assert got[name].error and got[name].gray is None


def test_only_ppm_and_no_requests(spark, pictures):
    folder, _ = pictures
    assert fetch(spark, folder, ["scene.ppm"])["scene.ppm"].w == 40
    assert fetch(spark, folder, []) == {}
