"""Registry of the four sources and the pieces each one plugs in."""

from __future__ import annotations

from ..operators import normalize
from .dimensions import SEND_PRIORITY
from .policies import BMS_POLICY, BMV_POLICY, MPPT_POLICY, RTD_POLICY, Source

SOURCES = {
    "bmv": Source(normalize.bmv, BMV_POLICY, "BMV", SEND_PRIORITY["bmv"]),
    "bms": Source(normalize.bms, BMS_POLICY, "BMS", SEND_PRIORITY["bms"]),
    "rtd": Source(normalize.rtd, RTD_POLICY, "RTD", SEND_PRIORITY["rtd"]),
    "mppt": Source(normalize.mppt, MPPT_POLICY, "MPPT", SEND_PRIORITY["mppt"]),
}
