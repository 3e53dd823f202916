"""Column expressions for paths over the globe, the sun and the ionosphere. Angles are in degrees, distances in km."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
LIGHT_KM_S = 299_792.458
#: 40.3 m^3/s^2, and electrons per square metre in one TEC unit.
GROUP_DELAY, TECU = 40.3, 1e16


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere by the haversine formula, within 0.5 % of the geodesic's."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of the great circle."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x, y = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.degrees(F.atan2(F.sin(a) + F.sin(b), F.sqrt(F.pow(F.cos(a) + x, 2) + y * y)))
    lon = lon1 + F.degrees(F.atan2(y, F.cos(a) + x))
    return lat, F.pmod(lon + 540, F.lit(360.0)) - 180


def obliquity(elevation: Column, shell_km: float = 350.0) -> Column:
    """Slant over vertical at a thin shell: elevation of 3 degrees at least, factor of 10 at most."""
    sine = EARTH_KM * F.cos(F.radians(F.greatest(elevation, F.lit(3.0)))) / (EARTH_KM + shell_km)
    return F.least(1 / F.sqrt(1 - sine * sine), F.lit(10.0))


def vertical_tec(slant: Column, elevation: Column, shell_km: float = 350.0) -> Column:
    return slant / obliquity(elevation, shell_km)


def hop_elevation(distance: Column, height: Column, hops: Column) -> Column:
    """Elevation angle of a path of equal hops that turn at ``height``."""
    angle = distance / (2 * hops * EARTH_KM)
    return F.degrees(F.atan2((EARTH_KM + height) * F.cos(angle) - EARTH_KM, (EARTH_KM + height) * F.sin(angle)))


def hop_path_km(distance: Column, height: Column, hops: Column) -> Column:
    """Length of that path."""
    angle = distance / (2 * hops * EARTH_KM)
    top = EARTH_KM + height
    return 2 * hops * F.sqrt(F.lit(EARTH_KM) ** 2 + top * top - 2 * EARTH_KM * top * F.cos(angle))


def hops_needed(distance: Column, height: Column) -> Column:
    """Fewest hops whose rays leave at the horizon or above."""
    return F.greatest(F.ceil(distance / (2 * EARTH_KM * F.acos(EARTH_KM / (EARTH_KM + height)))), F.lit(1)).cast("int")


def height_of_path(path_km: Column, distance: Column, hops: Column) -> Column:
    """The height at which hops of that length turn."""
    angle, half = distance / (2 * hops * EARTH_KM), path_km / (2 * hops)
    inside = half * half - F.pow(EARTH_KM * F.sin(angle), 2)
    return F.when(inside >= 0, EARTH_KM * F.cos(angle) + F.sqrt(inside) - EARTH_KM)


def group_delay_ms(tec: Column, frequency_mhz: Column, hops: Column, elevation: Column) -> Column:
    """Delay by the ionosphere, crossed twice in each hop, over that in a vacuum; the slant factor is 5 from 5 degrees down."""
    slant = F.when(elevation > 5, 1 / F.sin(F.radians(elevation))).otherwise(5.0)
    f = frequency_mhz * 1e6
    return GROUP_DELAY * tec * TECU * slant / (LIGHT_KM_S * 1e3 * f * f) * 2 * hops * 1e3


def solar_elevation(at: Column, lat: Column, lon: Column) -> Column:
    """Elevation of the sun, to a few tenths of a degree."""
    day = F.dayofyear(at) + (F.hour(at) - 12) / 24
    g = 2 * F.pi() / 365 * (day - 1)
    tilt = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    minutes = F.hour(at) * 60 + F.minute(at) + F.second(at) / 60 + equation + 4 * lon
    turn = F.radians(minutes / 4 - 180)
    sine = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(turn)
    return F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))))


def f2_critical_mhz(elevation: Column, noon: float = 10.9, night: float = 3.0) -> Column:
    """Critical frequency of the F2 layer: a Chapman layer by day, linear to the night's floor at -18 degrees."""
    day = F.greatest(noon * F.pow(F.greatest(F.sin(F.radians(elevation)), F.lit(0.01)), F.lit(0.25)), F.lit(night))
    dusk = night + (elevation + 18) / 18 * (noon * 0.6 - night)
    return F.when(elevation <= -18, night).when(elevation <= 0, dusk).otherwise(day)


def e_critical_mhz(elevation: Column, sunspots: float = 70.0, night: float = 0.5) -> Column:
    """Critical frequency of the E layer, and a floor below the horizon."""
    day = 0.9 * F.pow((180 + 1.44 * sunspots) * F.greatest(F.sin(F.radians(elevation)), F.lit(0.0)), F.lit(0.25))
    return F.when(elevation <= 0, night).otherwise(F.greatest(day, F.lit(night)))


def oblique_muf_mhz(critical: Column, elevation: Column, height: float = 300.0) -> Column:
    """Highest frequency that returns at that elevation, by the secant law with a curved earth; 4.5 times the critical one at most."""
    factor = F.sqrt(F.lit(1 + 2 * height / EARTH_KM)) / F.greatest(F.sin(F.radians(elevation)), F.lit(0.05))
    return F.when((elevation <= 0) | (elevation >= 89), critical).otherwise(critical * F.least(factor, F.lit(4.5)))


def grid_latlon(grid: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a Maidenhead square of 4 or 6 characters."""
    at = lambda i, low: F.ascii(F.substring(F.upper(grid), i, 1)) - ord(low)
    fine = F.length(grid) >= 6
    lon = at(1, "A") * 20 + at(3, "0") * 2 + F.when(fine, (at(5, "A") + 0.5) / 12).otherwise(1.0) - 180
    lat = at(2, "A") * 10 + at(4, "0") + F.when(fine, (at(6, "A") + 0.5) / 24).otherwise(0.5) - 90
    return lat, lon
