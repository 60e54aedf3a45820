"""The bundle of raw inputs one ETL run consumes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RawSources:
    """Raw catalogue tables, columns as in ``schemas.RAW_COLUMNS``.

    ``actor_people`` is the person table used to name credited actors; it is
    the same table as ``people`` for the public catalogue and differs only in
    the driver-table mapping, whose two person tables have overlapping ids.
    """

    basics: DataFrame
    ratings: DataFrame
    crew: DataFrame
    people: DataFrame
    principals: DataFrame
    akas: DataFrame
    episode: DataFrame
    actor_people: DataFrame | None = None

    @property
    def people_for_actors(self) -> DataFrame:
        return self.people if self.actor_people is None else self.actor_people

    @classmethod
    def from_raw_dict(cls, raw: dict[str, DataFrame]) -> "RawSources":
        return cls(
            basics=raw["title.basics"],
            ratings=raw["title.ratings"],
            crew=raw["title.crew"],
            people=raw["name.basics"],
            principals=raw["title.principals"],
            akas=raw["title.akas"],
            episode=raw["title.episode"],
        )
