"""Array maths as column expressions: signals, vectors and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def rms(a: Column) -> Column:
    """Root mean square; 0 for an empty signal."""
    total = F.aggregate(a, zero(), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(a) > 0, F.sqrt(total / F.size(a))).otherwise(zero())


def normalise(a: Column, target_db: float = -20.0) -> Column:
    """A signal at the target level, clipped to [-1, 1]; silence stays as it is."""
    gain = F.lit(10 ** (target_db / 20)) / rms(a)
    return F.when(rms(a) < 1e-10, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.transform(a, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * gain)))
    )


def fade(a: Column, most: int) -> Column:
    """Linear fade at both ends over at most ``most`` samples and a sixth of the signal."""
    n = F.least(F.lit(most), F.floor(F.size(a) / 6)).cast("int")
    last = F.size(a) - 1
    factor = lambda i: F.least(F.lit(1.0), i / (n - 1), (last - i) / (n - 1))
    return F.when(n < 2, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x, i: x.cast("double") * factor(i)))


def with_silence(a: Column, samples: Column) -> Column:
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(zero(), samples))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero(), lambda s, x: s + F.coalesce(x, zero()))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(zero())


def valid_codes(a: Column, most: int = 65_536) -> Column:
    return (F.size(a) > 0) & F.forall(a, lambda x: (x >= 0) & (x < most))


def padded(a: Column, size: int, pad: int = 0) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), size)), 1, size)


def label_mask(ids: Column, start: int, ignore: int = -100) -> Column:
    """The ids from the first ``start`` on; everything before it, or all without one, is ignored."""
    at = F.array_position(ids, start)
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i + 1 >= at), x).otherwise(F.lit(ignore)))


def hash_choice(c: Column, n: int) -> Column:
    """SHA-256 of a lower-case name modulo n, digit by digit in base 16."""
    digits = F.transform(F.split(F.sha2(F.lower(c).cast("binary"), 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda s, d: (s * 16 + d) % n)


def prosody(emotion: Column, intensity: Column) -> Column:
    """(speed, pitch) of an emotion at an intensity; the neutral one for others."""
    e, i = F.lower(F.coalesce(emotion, F.lit("neutral"))), F.coalesce(intensity, F.lit(1.0))
    speed = F.when(e == "angry", 1 + 0.5 * i).when(e == "sad", 1 - 0.3 * i).when(e == "happy", 1 + 0.4 * i).otherwise(F.lit(1.0))
    pitch = F.when(e == "angry", 1 + 0.5 * i).when(e == "sad", 1 - 0.3 * i).otherwise(F.lit(1.0))
    two = lambda c: F.floor(F.lit(100) * c + 0.5) / 100
    return F.struct(two(speed).alias("speed"), two(pitch).alias("pitch"))
