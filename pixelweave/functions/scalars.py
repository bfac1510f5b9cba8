"""Scalar functions on pixel values and noise parameters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelweave.sources.rasters import BLACK, WHITE

RANGE = float(WHITE - BLACK)
# fixed values: white balance gains and the color matrix from sensor to linear RGB
GAINS = {"r": 2.394, "g": 1.0, "b": 1.597}
CCM = ((1.9712, -0.7503, -0.2209), (-0.2491, 1.4727, -0.2236), (0.0172, -0.4864, 1.4692))


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def normalized(v: Column) -> Column:
    """Sensor value to [0, 1]."""
    return clip((v.cast("double") - float(BLACK)) / RANGE, 0.0, 1.0)


def quantized_u16(v: Column) -> Column:
    """[0, 1] back to a sensor value, truncated."""
    return clip(v * RANGE + float(BLACK), 0.0, float(WHITE)).cast("int")


def quantized_u8(v: Column, *, rounded: bool = False) -> Column:
    """0..255, truncated or rounded half up."""
    v = clip(v, 0.0, 255.0)
    return (F.floor(v + 0.5) if rounded else v).cast("int")


def vst(x: Column, a: Column | float, variance: Column | float) -> Column:
    """Variance stabilization for noise of variance a * x + variance."""
    a, b = _double(a), _double(variance)
    return 2.0 * F.sqrt(F.greatest(x / a + 0.375 + b / (a * a), F.lit(0.0)))


def gat(x: Column, a: Column | float, sigma: Column | float) -> Column:
    """The same with a standard deviation."""
    sigma = _double(sigma)
    return vst(x, a, sigma * sigma)


def gat_inverse(d: Column, a: Column | float, sigma: Column | float) -> Column:
    """Asymptotically unbiased inverse."""
    a, s = _double(a), _double(sigma)
    return a * ((d / 2.0) * (d / 2.0) - 0.125 - s * s / (a * a))


def vst_inverse(f: Column, a: Column | float, variance: Column | float) -> Column:
    """Algebraic inverse; its constant is 3/8, not 1/8."""
    a, b = _double(a), _double(variance)
    return a * (f * f / 4.0 - 0.375 - b / (a * a))


def param_units(a: Column, b: Column) -> dict[str, Column]:
    """Calibrated a, b of the sensor's scale as the gain, variance and standard deviation on [0, 1]."""
    b = F.greatest(b, F.lit(0.0))
    return {"a_norm": a / RANGE, "b_var": b / (RANGE * RANGE), "b_std": F.sqrt(b) / RANGE}


def srgb(v: Column) -> Column:
    """Linear light to the sRGB curve."""
    v = clip(v, 0.0, 1.0)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def balanced(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """White balance, clipped."""
    return tuple(clip(v * GAINS[k], 0.0, 1.0) for k, v in (("r", r), ("g", g), ("b", b)))


def color_corrected(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Color matrix, clipped."""
    return tuple(clip(r * m[0] + g * m[1] + b * m[2], 0.0, 1.0) for m in CCM)


def method_noise(noisy: Column, denoised: Column) -> Column:
    return quantized_u8(noisy - denoised + 128.0)


def residual(denoised: Column, y: Column) -> Column:
    """Five times the absolute difference, clipped, for display."""
    return clip(F.abs(denoised - y) * 5.0, 0.0, 1.0)


def ycrcb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Eight-bit luma and chroma (BT.601, full range)."""
    y = r * 0.299 + g * 0.587 + b * 0.114
    rounded = lambda v: quantized_u8(v, rounded=True)
    return {"luma": rounded(y), "cr": rounded((r - y) * 0.713 + 128.0), "cb": rounded((b - y) * 0.564 + 128.0)}


def from_ycrcb(luma: Column, cr: Column, cb: Column) -> dict[str, Column]:
    """Eight-bit colors from luma and chroma (BT.601, full range)."""
    cr, cb = cr - 128.0, cb - 128.0
    rounded = lambda v: quantized_u8(F.round(v, 9), rounded=True)
    return {"r": rounded(luma + cr * 1.403), "g": rounded(luma - cr * 0.714 - cb * 0.344), "b": rounded(luma + cb * 1.773)}


def _double(v: Column | float) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else v.cast("double")
