"""Raw device values to engineering units, one function per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary as b
from ..functions.numeric import (
    c_to_f,
    py_round,
    read_int,
    resistance,
    sensor_fault_names,
    temperature,
)
from ..plans import dimensions as dim

FRAME_BYTES = 8


def bmv(df: DataFrame, values: str = "fields") -> DataFrame:
    """Text map of the battery shunt to typed columns; the state of charge comes per mille."""
    m = F.col(values)
    return df.select(
        *[c for c in df.columns if c != values],
        F.lit("bmv").alias("device_type"),
        read_int(m, "V", default=0).alias("voltage_mv"),
        read_int(m, "I", default=0).alias("current_ma"),
        read_int(m, "P", default=0).alias("power_w"),
        (read_int(m, "SOC").cast("double") / F.lit(10.0)).alias("charge_state"),
        read_int(m, "Alarm", "AR", default=0).alias("alarm"),
    )


def cell_stats(cells: Column) -> Column:
    """Struct of the fitted cells' extremes; NULL members when no cell is fitted.

    Indexes count from 1, and on ties the first cell wins: each extreme is taken over pairs
    of the voltage and the position, of any number of cells. Written with short lambdas, since
    spelling out every cell makes one method too long for the JVM to compile.
    """
    def fitted(mv):
        return mv >= dim.FITTED_CELL_MV

    high = F.transform(cells, lambda mv, i: F.when(
        fitted(mv), F.struct(mv.alias("mv"), (-i).alias("at"))))
    low = F.transform(cells, lambda mv, i: F.when(
        fitted(mv), F.struct(mv.alias("mv"), i.alias("at"))))
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda acc, mv: acc + F.when(
        fitted(mv), mv).otherwise(0))
    return F.struct(
        F.size(F.filter(cells, fitted)).alias("fitted"), F.array_max(high).alias("top"),
        F.array_min(low).alias("bottom"), total.alias("total"))


def _cell_columns(stats: str) -> list[Column]:
    top, bottom = F.col(f"{stats}.top"), F.col(f"{stats}.bottom")
    high, low = top["mv"].cast("int"), bottom["mv"].cast("int")
    return [
        high.alias("cell_v_max_mv"),
        low.alias("cell_v_min_mv"),
        (high - low).alias("cell_v_delta_mv"),
        (1 - top["at"]).cast("int").alias("cell_max_idx"),
        (1 + bottom["at"]).cast("int").alias("cell_min_idx"),
        F.when(F.col(f"{stats}.fitted") > 0, F.col(f"{stats}.total") / F.lit(1000.0))
        .alias("cell_sum_v"),
    ]


def with_cell_stats(df: DataFrame, cells: str = "cells_mv") -> DataFrame:
    """Add ``fitted`` and the extremes, spread and sum of the fitted cells."""
    return df.withColumn("_stats", cell_stats(F.col(cells))).select(
        *df.columns, F.col("_stats.fitted").alias("fitted"), *_cell_columns("_stats"))


def missing_registers(registers: Column) -> Column:
    required = sorted(dim.BATTERY_REGISTERS.values())
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(registers))


def _entries(registers: Column, addresses: Sequence[int]) -> Column:
    """The map's entries at some addresses, each looked up by a compiled expression: a lambda
    would be interpreted for every entry of every poll."""
    return F.when(registers.isNotNull(), F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.map_contains_key(registers, r), F.struct(
            F.lit(r).alias("key"), F.try_element_at(registers, F.lit(r)).alias("value")))
        for r in addresses]))))


def bms(df: DataFrame, registers: str = "registers", current_sign: int = 1) -> DataFrame:
    """Battery register map to typed columns; ``reject_reason`` names missing registers.

    Registers nobody has identified are passed through in ``unidentified``.
    """
    regs = F.col(registers)

    def reg(name):
        return F.try_element_at(regs, F.lit(dim.BATTERY_REGISTERS[name]))

    def hundredths(value):
        return value.cast("double") / F.lit(100.0)

    first = dim.BATTERY_REGISTERS["cell_first"]
    cells = F.array(*[F.coalesce(F.try_element_at(regs, F.lit(r)), F.lit(0))
                      for r in range(first, first + dim.CELLS)])
    missing = missing_registers(regs)
    return (
        df.withColumns({"cells_mv": cells, "_missing": missing})
        .withColumn("_stats", cell_stats(F.col("cells_mv")))
        .select(
            *[c for c in df.columns if c != registers],
            F.lit("bms").alias("device_type"),
            F.when(F.size("_missing") > 0, F.concat(
                F.lit("missing registers "), F.array_join("_missing", ","))).alias("reject_reason"),
            hundredths(reg("pack_voltage")).alias("battery_voltage_v"),
            hundredths(b.sign_extend(reg("current"), 16) * current_sign)
            .alias("battery_current_a"),
            reg("soc").alias("soc_pct"),
            reg("soh").alias("soh_pct"),
            hundredths(reg("remaining_ah")).alias("remaining_ah"),
            hundredths(reg("full_ah")).alias("full_capacity_ah"),
            reg("cycle_count").alias("cycle_count"),
            b.sign_extend(reg("temp_max"), 16).alias("temp_max_c"),
            reg("cell_count").alias("cell_count"),
            *_cell_columns("_stats"),
            "cells_mv",
            _entries(regs, dim.UNIDENTIFIED_REGISTERS).alias("unidentified"))
    )


def quality_violations(cell_sum_v: Column, pack_v: Column, soc_pct: Column) -> Column:
    """Names of the sanity rules a battery reading breaks, as an array."""
    return F.array_compact(F.array(
        F.when(F.abs(cell_sum_v - pack_v) > 1.0, F.lit("cell sum differs from pack voltage")),
        F.when(cell_sum_v.isNull(), F.lit("no cell voltages")),
        F.when(soc_pct > 100, F.lit("soc above 100"))))


def with_quality(readings: DataFrame) -> DataFrame:
    return readings.withColumn("violations", quality_violations(
        F.col("cell_sum_v"), F.col("battery_voltage_v"), F.col("soc_pct")))


def mppt(df: DataFrame, base_device: int = 1, data: str = "data") -> DataFrame:
    """Bus frames of the solar trackers to power or status columns.

    The board index is the position of ``can_id >> 4`` in the board list. Ids that are
    not mapped, or packets that are neither power nor status, get a ``reject_reason``.
    Both lookups are fixed lists of a dozen entries at most.
    """
    spark = df.sparkSession
    ids = dim.bus_id_table(spark).select("can_id", "mppt_index")
    raw = F.rpad(b.hex_text(F.col(data)), 2 * FRAME_BYTES, "0")
    raw = F.when(F.length(data) >= FRAME_BYTES, b.hex_text(F.col(data))).otherwise(raw)
    work = (
        df.withColumn("raw_hex", raw)
        .drop("mppt_index", "packet_id")
        .join(F.broadcast(ids), "can_id", "left")
        .withColumn("packet_id", F.col("can_id").bitwiseAND(F.lit(15)))
    )
    mapped = F.col("mppt_index").isNotNull()
    power = mapped & (F.col("packet_id") == dim.POWER_PACKET)
    status = mapped & (F.col("packet_id") == dim.STATUS_PACKET)
    h = F.col("raw_hex")

    def scaled(at, factor):
        return F.when(power, b.signed_at(h, at, 2).cast("double") * F.lit(factor))

    def byte(at, signed=False):
        read = b.signed_at if signed else b.unsigned_at
        return F.when(status, read(h, at, 1).cast("double"))

    work = work.withColumns({
        "reject_reason": F.when(~mapped, "unmapped can_id"),
        "pv_voltage_v": scaled(0, 0.01),
        "pv_current_a": scaled(2, 0.0005),
        "battery_voltage_v": scaled(4, 0.01),
        "battery_current_a": scaled(6, 0.0005),
        "mode": byte(0),
        "fault": byte(1),
        "enabled": byte(2),
        "ambient_temp_c": byte(3, True),
        "heatsink_temp_c": byte(4, True),
    })
    work = (
        work.withColumn("pv_power_w", py_round(F.col("pv_voltage_v") * F.col("pv_current_a"), 3))
        .join(F.broadcast(dim.mode_table(spark)),
              F.col("mode").cast("int") == F.col("mode_code"), "left")
        .join(F.broadcast(dim.fault_table(spark)),
              F.col("fault").cast("int") == F.col("fault_code"), "left")
    )

    def named(code, label):
        unknown = F.concat(F.lit("Unknown("), code.cast("int").cast("string"), F.lit(")"))
        return F.when(code.isNotNull(), F.coalesce(label, unknown))

    kept = [c for c in df.columns if c not in (data, "mppt_index", "packet_id", "kind")]
    return work.select(
        *kept, F.lit("mppt").alias("device_type"),
        (F.col("mppt_index") + base_device).alias("device_id"),
        "mppt_index", "packet_id", "reject_reason",
        "pv_voltage_v", "pv_current_a", "pv_power_w", "battery_voltage_v", "battery_current_a",
        "mode", named(F.col("mode"), F.col("mode_label")).alias("mode_name"),
        "fault", named(F.col("fault"), F.col("fault_label")).alias("fault_name"),
        "enabled", "ambient_temp_c", "heatsink_temp_c", "raw_hex")


def rtd(df: DataFrame, code: str = "raw_code", fault: str = "fault_status") -> DataFrame:
    """Sensor code to resistance and temperature; a faulted reading has neither.

    A code of 0 without a fault means the board is not converting.
    """
    found = F.coalesce(F.col(fault), F.lit(0))
    found = F.when((found == 0) & (F.col(code) == 0), dim.FAULT_NO_SIGNAL).otherwise(found)
    ohm = resistance(F.col(code))
    sound = F.col("fault") == 0
    return (
        df.withColumn("fault", found.cast("int"))
        .withColumn("_ohm", F.when(sound, ohm))
        .withColumn("_celsius", F.when(sound, temperature(F.col("_ohm"))))
        .select(
            *[c for c in df.columns if c not in (fault, "fault")],
            F.lit("rtd").alias("device_type"),
            "fault", sensor_fault_names(F.col("fault")).alias("fault_name"),
            py_round(F.col("_ohm"), 3).alias("resistance_ohm"),
            py_round(F.col("_celsius"), 2).alias("motor_temp_c"),
            py_round(c_to_f(F.col("_celsius")), 2).alias("motor_temp_f"))
    )
