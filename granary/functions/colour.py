"""Colour and place arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The D65 white point, hue bounds of the buckets, and the chroma below which a colour is neutral.
WHITE = (95.047, 100.0, 108.883)
HUES = ((12, "red"), (42, "orange"), (72, "yellow"), (165, "green"), (200, "teal"), (258, "blue"), (310, "purple"), (345, "pink"), (360, "red"))
NEUTRAL = 12.0


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values that are computed once for a row, however often the body names them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def lab_struct(r: Column, g: Column, b: Column) -> Column:
    """(l, a, b): CIELAB of sRGB channels 0..255."""
    def linear(c):
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    def f(t):
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    def whole(v):
        return _let(xyz, r=linear(v["r"]), g=linear(v["g"]), b=linear(v["b"]))

    def xyz(v):
        r, g, b = v["r"], v["g"], v["b"]
        x, y, z = (r * 0.4124 + g * 0.3576 + b * 0.1805) * 100, (r * 0.2126 + g * 0.7152 + b * 0.0722) * 100, (r * 0.0193 + g * 0.1192 + b * 0.9505) * 100
        return _let(cubes, x=x / WHITE[0], y=y / WHITE[1], z=z / WHITE[2])

    def cubes(v):
        return _let(axes, x=f(v["x"]), y=f(v["y"]), z=f(v["z"]))

    def axes(v):
        return F.struct((116 * v["y"] - 16).alias("l"), (500 * (v["x"] - v["y"])).alias("a"), (200 * (v["y"] - v["z"])).alias("b"))

    return _let(whole, r=r, g=g, b=b)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB of sRGB channels 0..255 as three columns; ``lab_struct`` computes them once."""
    v = lab_struct(r, g, b)
    return v["l"], v["a"], v["b"]


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB channels 0..255 of a CIELAB colour; what sRGB cannot show is cut to its bounds."""
    fy = (l + 16) / 116
    f = lambda t: F.when(F.pow(t, 3) > 0.008856, F.pow(t, 3)).otherwise((t - 16 / 116) / 7.787)
    x, y, z = (f(t) * w / 100 for t, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True))
    linear = (x * 3.2406 - y * 1.5372 - z * 0.4986, x * -0.9689 + y * 1.8758 + z * 0.0415, x * 0.0557 - y * 0.2040 + z * 1.0570)
    s = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c)
    return tuple(F.round(F.least(F.greatest(s(c), F.lit(0.0)), F.lit(1.0)) * 255).cast("int") for c in linear)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue of HSV in degrees; 0 for grey."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(hi - lo < 1e-9 * 255, F.lit(1.0)).otherwise(hi - lo)
    h = F.when(hi == r, 60 * F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
    return F.when(hi - lo < 1e-9 * 255, 0.0).otherwise(F.pmod(h, F.lit(360.0)))


def bucket(r: Column, g: Column, b: Column, digits: int | None = None) -> Column:
    """The name of one of twelve colour groups of an sRGB colour; with ``digits``, as its CIELAB axes rounded to so many decimals tell."""
    def axis(m, x):
        return m["lab"][x] if digits is None else F.round(m["lab"][x], digits)

    def measures(v):
        return _let(lambda m: _let(name, l=axis(m, "l"), chroma=F.hypot(axis(m, "a"), axis(m, "b")), h=m["h"]), lab=lab_struct(v["r"], v["g"], v["b"]), h=hue(v["r"].cast("double"), v["g"].cast("double"), v["b"].cast("double")))

    def name(v):
        l, chroma, h = v["l"], v["chroma"], v["h"]
        out = F.when((chroma < NEUTRAL) & (l < 22), "black").when((chroma < NEUTRAL) & (l > 85), "white").when(chroma < NEUTRAL, "gray").when(l < 12, "black")
        out = out.when((h >= 12) & (h < 55) & (l < 60) & (chroma < 60), "brown")
        for limit, group in HUES:
            out = out.when((h < limit) & (l > 70) & (chroma < 45), "pink").when(h < limit, group) if group == "red" else out.when(h < limit, group)
        return out.otherwise("red")

    return _let(measures, r=r, g=g, b=b)


def rgb(hex_: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(hex_, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def geohash(lat: Column, lon: Column, length: int = 9) -> Column:
    """Base-32 geohash by interleaving the bits of both coordinates."""
    bits = 5 * length
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, lo, span, n: F.least(F.floor((v - lo) / span * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    chars = []
    for i in range(length):
        v = F.lit(0)
        for k in range(5):
            at = 5 * i + k  # even places are bits of the longitude
            src, n = (x, lon_bits) if at % 2 == 0 else (y, lat_bits)
            v = v + F.shiftleft(F.shiftright(src, n - 1 - at // 2).bitwiseAND(F.lit(1)).cast("int"), 4 - k)
        chars.append(F.substr(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), (v + 1).cast("int"), F.lit(1)))
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.concat(*chars))


def from_dms(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to signed degrees."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def iso6709(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a string such as +48.8577+002.295/."""
    p = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    return F.try_to_number(F.regexp_extract(text, p, 1), F.lit("S999.999999")).cast("double"), F.try_to_number(F.regexp_extract(text, p, 2), F.lit("S999.999999")).cast("double")


#: Least shortest side of each resolution label.
SIDES = ((2000, "8k"), (1400, "4k"), (1000, "1440p"), (700, "1080p"), (500, "720p"), (400, "480p"))


def resolution(width: Column, height: Column) -> Column:
    """A label by the shortest side (bounds as catalogues of this kind have them: 1080 lines are "1440p")."""
    out = F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), "unknown resolution")
    for least, name in SIDES:
        out = out.when(F.least(width, height) >= least, name)
    return out.otherwise("low resolution")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit perceptual hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def near_hashes(rows: DataFrame, key: str, h: str, most: int = 7) -> DataFrame:
    """(a, b, distance) of rows whose 64-bit hashes differ in at most ``most`` bits (up to 7).

    Multi-index probing: seven flips leave one of four 16-bit bands with at most one flip, so each
    hash is posted under its four bands and looked up under the 17 values of each band at
    distance 0 or 1. That forms N² · 68 / 65,536 candidates of evenly spread hashes. Equal hashes are one class, which is
    compared once and expanded only into the pairs that are asked for; a pair of classes is formed
    only at the first of its bands with at most one flip.
    """
    if not 0 <= most <= 7:
        raise ValueError("at most 7 bits")
    band = lambda c, k: F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")
    own = rows.select(F.col(key).alias("id"), F.col(h).alias("h"))
    classes = own.select("h").distinct()
    posts = classes.select(F.col("h").alias("h2"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), band(F.col("h"), k).alias("v")) for k in range(4)])).alias("p")).select("h2", "p.k", "p.v")
    flips = F.array(*[F.lit(m) for m in (0, *(1 << i for i in range(16)))])
    near = lambda k: F.transform(flips, lambda m: F.struct(F.lit(k).alias("k"), band(F.col("h"), k).bitwiseXOR(m).alias("v")))
    probes = F.flatten(F.array(*[near(k) for k in range(4)]))
    x = classes.select("h", F.explode(probes).alias("p")).select("h", "p.k", "p.v")
    first = F.lit(4)
    for k in reversed(range(4)):
        first = F.when(F.bit_count(band(F.col("h"), k).bitwiseXOR(band(F.col("h2"), k))) <= 1, k).otherwise(first)
    met = x.join(posts, ["k", "v"]).filter((F.col("h") < F.col("h2")) & (hamming(F.col("h"), F.col("h2")) <= most) & (F.col("k") == first)).select("h", "h2")
    met = met.unionByName(classes.select("h", F.col("h").alias("h2")))
    pairs = met.join(own.toDF("a", "h"), "h").join(own.toDF("b", "h2"), "h2")
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return pairs.filter((F.col("h") != F.col("h2")) | (F.col("a") < F.col("b"))).select(a.alias("a"), b.alias("b"), hamming(F.col("h"), F.col("h2")).alias("distance"))
