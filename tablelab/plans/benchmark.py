"""Extract -> assemble -> validate: documents of both layouts into the wide table, its trail and rule figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators.profile import value_pairs


@dataclass
class Assembled:
    table: DataFrame
    trail: DataFrame
    pairs: DataFrame


def assemble(
    template: DataFrame,
    entity: str,
    paged: DataFrame,
    coded: DataFrame,
    names: DataFrame,
    source: str,
    cite: str,
    preserved: Sequence[str] = (),
) -> Assembled:
    """``paged`` (doc_id, page, text) and ``coded`` (doc_id, text) documents; ``names`` maps doc_id to the entity.

    Preserved entities keep the template's values but still appear among the pairs.
    """
    found = {
        "paged": ex.extract(paged, "doc_id", "text", ex.PAGED_ENDPOINTS, page="page"),
        "coded": ex.extract(coded, "doc_id", "text", ex.CODED_ENDPOINTS),
    }
    table = template
    trails, pairs = [], []
    for form, records in found.items():
        mapped = ex.look_up(records, names, "doc_id", entity)
        usable = mapped.filter(~F.col(entity).isin(list(preserved))) if preserved else mapped
        table = ex.fill(table, usable, entity, source, cite, with_code=form == "coded")
        trails.append(ex.audit(usable.filter(F.col("endpoint").isin(list(ex.FIELDS))), entity, "doc_id", form))
        wide = ex.wide_records(mapped, entity, ["DT50_soil_d", "DT50_soil_typical"])
        pairs.append(wide.select(entity, F.col("DT50_soil_d.value").alias("lab"), F.col("DT50_soil_typical.value").alias("typical")))
    both = pairs[0].unionByName(pairs[1])
    return Assembled(table, trails[0].unionByName(trails[1], allowMissingColumns=True), value_pairs(both, entity, "lab", "typical"))
