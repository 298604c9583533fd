"""Geocoders behind one interface, and one that knows a table of places. Nothing here uses the network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from larder.runtime import materialise, ship
from larder.sources import readers

PLACES = "address string, latitude double, longitude double"


class Geocoder(Protocol):
    """Coordinates (latitude, longitude) of an address, None where it is not known. Any error counts as not known."""

    def geocode(self, address: str) -> tuple[float, float] | None: ...


class KnownPlaces:
    """A stand-in that knows the addresses of a dictionary."""

    def __init__(self, places: dict[str, tuple[float, float]]):
        self.places = places

    def geocode(self, address: str) -> tuple[float, float] | None:
        return self.places.get(address)


def read_places(spark: SparkSession, path: str) -> KnownPlaces:
    """From a small CSV with address, latitude, longitude; later rows win."""
    rows = readers.read_dictionary(spark, path, ("address", "latitude", "longitude"), required=3)
    return KnownPlaces({a: (float(y), float(x)) for a, y, x in rows})


def geocode(addresses: DataFrame, geocoder: Geocoder) -> DataFrame:
    """(address, latitude, longitude) of the distinct addresses that the geocoder knows. Answers are written, so that no later
    read asks again."""
    ship(addresses.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = []
            for address in df["address"]:
                try:
                    at = geocoder.geocode(address)
                except Exception:  # noqa: BLE001  one address that fails leaves the others
                    at = None
                if at is not None:
                    found.append((address, float(at[0]), float(at[1])))
            yield pd.DataFrame(found, columns=["address", "latitude", "longitude"])

    asked = materialise(addresses.filter("address is not null").distinct(), "to-geocode")
    return materialise(asked.mapInPandas(run, PLACES), "geocoded")
