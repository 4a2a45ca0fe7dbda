"""Column functions that decode ship types and arrival times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of single ship-type codes, and of the tens digit of the others.
SHIP_TYPES = {
    30: "Fishing", 31: "Towing", 32: "Towing", 33: "Dredging", 34: "Diving Ops", 35: "Military Ops", 36: "Sailing", 37: "Pleasure Craft",
    50: "Pilot Vessel", 51: "Search & Rescue", 52: "Tug", 53: "Port Tender", 54: "Anti-pollution", 55: "Law Enforcement", 58: "Medical Transport", 59: "Non-combatant Ship",
}
SHIP_TYPE_TENS = {2: "Wing-in-Ground", 3: "Fishing / Special", 4: "High-Speed Craft", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other"}


def ship_type(code: Column) -> Column:
    """Label of a ship-type code; missing, not numeric or not positive: Unknown."""
    number = code.try_cast("int")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    tens = F.coalesce(F.try_element_at(table(SHIP_TYPE_TENS), F.floor(number / 10).cast("int")), F.lit("Other"))
    return F.when(number.isNull() | (number <= 0), "Unknown").otherwise(F.coalesce(F.try_element_at(table(SHIP_TYPES), number), tens))


def eta(month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """``MM-dd HH:mm UTC``; null without month and day; hour 24 and minute 60 mean unset."""
    m, d = F.coalesce(month, F.lit(0)), F.coalesce(day, F.lit(0))
    h = F.when(F.coalesce(hour, F.lit(24)) == 24, F.lit(0)).otherwise(hour)
    n = F.when(F.coalesce(minute, F.lit(60)) == 60, F.lit(0)).otherwise(minute)
    return F.when((m != 0) & (d != 0), F.format_string("%02d-%02d %02d:%02d UTC", m.cast("int"), d.cast("int"), h.cast("int"), n.cast("int")))
