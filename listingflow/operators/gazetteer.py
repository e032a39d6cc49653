"""Place names: which city and district a record is in, without guessing.

The gazetteer is a table the caller supplies: ``city, region_id, district, section_id, ord``.
A small one (checked) becomes literal expressions, so resolving needs no join at all; a larger
one stays a table (``place_table``), with the same methods and results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import vocabulary as V
from ..functions.text import blank_to_null, labelled_field, normalize_spelling, strip
from ..functions.urls import query_value
from .place_table import PlaceTable

LITERAL_ROWS = 2_000


def _any_of(names: Sequence[str]) -> str:
    return "(" + "|".join(re.escape(n) for n in names) + ")"


def _by_length(names) -> list[str]:
    return sorted(names, key=lambda n: (-len(n), n))


def _first_listed(text: Column, names: Sequence[str]) -> Column:
    """First of ``names``, in list order, that occurs in the text."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.try_element_at(F.filter(listed, lambda n: F.contains(text, n)), F.lit(1))


@dataclass(frozen=True)
class Gazetteer:
    rows: tuple[tuple[str, int, str, int], ...]  # city, region id, district, section id
    legacy: tuple[tuple[int, int, str], ...] = ()  # region id, section id, label

    @classmethod
    def from_table(
        cls, table: DataFrame, legacy: Sequence[tuple[int, int, str]] = (), literal_rows: int = LITERAL_ROWS
    ) -> Gazetteer | PlaceTable:
        """As literal expressions up to ``literal_rows`` rows, as a table beyond; results are the same."""
        own = table.select("city", "region_id", "district", "section_id", "ord")
        got = own.orderBy("ord").limit(literal_rows + 1).collect()
        if len(got) > literal_rows:
            return PlaceTable(own, legacy)
        return cls(tuple((r.city, r.region_id, r.district, r.section_id) for r in got), tuple(legacy))

    @cached_property
    def cities(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for city, _, district, _ in self.rows:
            out.setdefault(city, []).append(district)
        return out

    @cached_property
    def owners(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for city, _, district, _ in self.rows:
            out.setdefault(district, []).append(city)
        return out

    def prepared(self, df: DataFrame) -> DataFrame:
        """Rows that several methods are to place: expressions read them once as they are."""
        return df

    # --- lookups as expressions ---------------------------------------------------

    def belongs(self, city: Column, district: Column) -> Column:
        out = F.lit(False)
        for name, districts in self.cities.items():
            out = F.when(city == name, district.isin(*districts)).otherwise(out)
        return out

    def only_city(self, district: Column) -> Column:
        """The one city with a district of this name; null if none or several."""
        single: dict[str, list[str]] = {}
        for name, owners in self.owners.items():
            if len(owners) == 1:
                single.setdefault(owners[0], []).append(name)
        out = F.lit(None).cast("string")
        for city, names in single.items():
            out = F.when(district.isin(*names), F.lit(city)).otherwise(out)
        return out

    def city_of(self, district: Column, preferred: Column | None = None) -> Column:
        name = normalize_spelling(district)
        if preferred is None:
            return self.only_city(name)
        city = normalize_spelling(preferred)
        return F.when(self.belongs(city, name), city).otherwise(self.only_city(name))

    def add_city_of(self, df: DataFrame, district: str, preferred: str, out: str) -> DataFrame:
        """The preferred city if the district is in it, else the one city that it is in."""
        return df.withColumn(out, self.city_of(F.col(district), F.col(preferred)))

    def earliest_city(self, text: Column) -> Column:
        return blank_to_null(F.regexp_extract(text, _any_of(sorted(self.cities)), 1))

    def earliest_district(self, text: Column, unique_only: bool = False) -> Column:
        names = [n for n, owners in self.owners.items() if not unique_only or len(owners) == 1]
        if not names:
            return F.lit(None).cast("string")
        return blank_to_null(F.regexp_extract(text, _any_of(_by_length(names)), 1))

    def earliest_district_of(self, city: Column, text: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, districts in self.cities.items():
            pattern = _any_of(_by_length(districts))
            out = F.when(city == name, F.regexp_extract(text, pattern, 1)).otherwise(out)
        return blank_to_null(out)

    def canonical_city(self, value: Column) -> Column:
        """A structured city value: exact, contained, or an unambiguous short form."""
        name = normalize_spelling(value)
        short: dict[str, list[str]] = {}
        for city in self.cities:
            short.setdefault(city[:-1], []).append(city)
        alias = F.lit(None).cast("string")
        for stem, cities in short.items():
            if len(cities) == 1:
                alias = F.when(name == stem, F.lit(cities[0])).otherwise(alias)
        return F.when(
            value != "",
            F.when(name.isin(*self.cities), name).otherwise(
                F.coalesce(_first_listed(name, _by_length(self.cities)), alias)
            ),
        )

    def canonical_district(self, value: Column) -> Column:
        name = normalize_spelling(value)
        return F.when(
            value != "",
            F.when(name.isin(*self.owners), name).otherwise(self.earliest_district(name)),
        )

    # --- resolution: staged projections, so each intermediate value is computed once ---

    def add_place(
        self, df: DataFrame, text: str, city: str | None = None, district: str | None = None, out: str = "place"
    ) -> DataFrame:
        """Add struct(city, district). Structured values scope the text; ambiguity stays null."""
        c = F.col
        none = F.lit(None).cast("string")
        staged = (
            df.withColumn("_name", normalize_spelling(c(text)))
            .withColumn("_given_city", self.canonical_city(c(city)) if city else none)
            .withColumn("_given", self.canonical_district(c(district)) if district else none)
            .withColumn("_city", F.coalesce("_given_city", self.earliest_city(c("_name"))))
            .withColumn("_owner", self.only_city(c("_given")))
            .withColumn("_bare", self.earliest_district(c("_name"), unique_only=True))
        )

        def place(a: Column, b: Column) -> Column:
            return F.struct(a.alias("city"), b.alias("district"))

        known = c("_city").isNotNull()
        chosen = (
            F.when(known & self.belongs(c("_city"), c("_given")), place(c("_city"), c("_given")))
            .when(~known & c("_owner").isNotNull(), place(c("_owner"), c("_given")))
            .when(known, place(c("_city"), self.earliest_district_of(c("_city"), c("_name"))))
            .otherwise(place(self.only_city(c("_bare")), c("_bare")))
        )
        return staged.select(*df.columns, chosen.alias(out))

    def add_place_longest_first(
        self, df: DataFrame, text: str, page_url: str | None = None, out: str = "place"
    ) -> DataFrame:
        """The portal's rule: names are tried by length, wherever they stand in the text."""
        c = F.col
        none = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("district"))
        staged = df.withColumn("_name", normalize_spelling(c(text)))
        if page_url:
            staged = self.add_place_of_page(staged, page_url, "_page")
        else:
            staged = staged.withColumn("_page", none)
        listed = F.array(*[F.lit(n) for n in _by_length(self.owners)])
        staged = staged.withColumn(
            "_preferred", F.coalesce(_first_listed(c("_name"), _by_length(self.cities)), c("_page.city"))
        ).withColumn("_named", F.filter(listed, lambda n: F.contains(c("_name"), n)))
        hits = F.transform(
            "_named",
            lambda n: F.struct(
                F.when(self.belongs(c("_preferred"), n), c("_preferred"))
                .otherwise(self.only_city(n))
                .alias("city"),
                n.alias("district"),
            ),
        )
        best = F.try_element_at(F.filter(hits, lambda h: h["city"].isNotNull()), F.lit(1))
        fallback = F.struct(c("_preferred").alias("city"), c("_page.district").alias("district"))
        return staged.select(*df.columns, F.coalesce(best, fallback).alias(out))

    # --- ids and names ------------------------------------------------------------

    def city_of_region(self, region_id: Column) -> Column:
        out = F.lit(None).cast("string")
        for region, city in {r: c for c, r, _, _ in self.rows}.items():
            out = F.when(region_id == str(region), F.lit(city)).otherwise(out)
        return out

    def district_of_section(self, region_id: Column, section_id: Column) -> Column:
        by_region: dict[int, list[tuple[int, str]]] = {}
        for _, region, district, section in self.rows:
            by_region.setdefault(region, []).append((section, district))
        for region, section, label in self.legacy:
            by_region.setdefault(region, []).append((section, label))
        out = F.lit(None).cast("string")
        for region, pairs in by_region.items():
            lookup = F.create_map(*[F.lit(x) for s, d in pairs for x in (str(s), d)])
            out = F.when(region_id == str(region), F.try_element_at(lookup, section_id)).otherwise(out)
        return out

    def add_place_of_page(self, df: DataFrame, page_url: str, out: str) -> DataFrame:
        """City and district named by the region and section ids of a search URL."""
        url = F.col(page_url)
        staged = df.withColumns(
            {
                "_region": blank_to_null(strip(F.substring_index(query_value(url, "region"), "-", 1))),
                "_section": strip(query_value(url, "section")),
            }
        )
        section = F.when(~F.contains("_section", F.lit("-")), blank_to_null(F.col("_section")))
        place = F.struct(
            self.city_of_region(F.col("_region")).alias("city"),
            self.district_of_section(F.col("_region"), section).alias("district"),
        )
        return staged.withColumn(out, place).drop("_region", "_section")

    # --- one city's board, with its short names -------------------------------------

    def add_place_on_board(
        self,
        df: DataFrame,
        text: str,
        out: str = "place",
        city: str = V.FORUM_CITY,
        stem: str = V.FORUM_CITY_STEM,
        aliases: Sequence[tuple[str, str]] = V.FORUM_AREA_ALIASES,
        elsewhere: str | None = None,
    ) -> DataFrame:
        """Add struct(city, district) for a post on one city's board.

        The address line is asked first; an address in another city rejects the post. Then
        the whole text, then the bracketed area of the title, where short names are known.
        ``elsewhere`` names a column with the first city on the address line, if it is known already.
        """
        c = F.col
        if city not in self.cities:  # a gazetteer without the board's city knows none of its places
            return df.withColumn(out, F.lit(None).cast("struct<city: string, district: string>"))
        stems = [(d.removesuffix("區"), d) for d in self.cities[city]]
        staged = (
            self.board_line(df, text, "_line")
            .withColumn("_name", normalize_spelling(c(text)))
            .withColumn("_area", normalize_spelling(bracket_area(c("_name"), stem)))
        )

        def named(t: Column) -> Column:
            official = blank_to_null(F.regexp_extract(t, _any_of(_by_length(self.cities[city])), 1))
            legacy = F.lit(None).cast("string")
            for short, district in reversed(stems):
                pattern = rf"(?U){stem}(?:市|縣)\s*{re.escape(short)}(?:區|市|鎮|鄉)"
                legacy = F.when(t.rlike(pattern), F.lit(district)).otherwise(legacy)
            return F.coalesce(official, legacy)

        def abbreviated(t: Column) -> Column:
            compact = strip(F.regexp_replace(t, r"(?U)[\s・·｜|／/\-—_][^\n]*\z", ""))
            known = dict([*stems, *aliases])
            out = F.lit(None).cast("string")
            for short in reversed(sorted(known, key=len, reverse=True)):
                out = F.when(compact.startswith(short), F.lit(known[short])).otherwise(out)
            return out

        staged = staged.withColumn("_other", c(elsewhere) if elsewhere else self.earliest_city(c("_line"))).withColumn(
            "_district",
            F.coalesce(
                named(c("_line")),
                abbreviated(c("_line")),
                named(c("_name")),
                named(c("_area")),
                abbreviated(c("_area")),
            ),
        )
        rejected = F.coalesce(c("_other") != city, F.lit(False))
        found_city = F.when(c("_district").isNotNull() | F.contains("_name", F.lit(city)), F.lit(city))
        place = F.struct(
            F.when(~rejected, found_city).alias("city"), F.when(~rejected, c("_district")).alias("district")
        )
        return staged.select(*df.columns, place.alias(out))


    def board_line(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """A post's address line, in one spelling."""
        return df.withColumn(out, normalize_spelling(labelled_field(normalize_spelling(F.col(text)), V.FORUM_ADDRESS_LABELS)))


def bracket_area(text: Column, stem: str = V.FORUM_CITY_STEM) -> Column:
    """``[kind/city/area]`` at the head of a title: the area."""
    pattern = rf"(?U)[\[［][^/\]］]{{1,16}}/\s*{stem}(?:市|縣)?\s*/\s*([^/\]］\r\n]+)[\]］]"
    return strip(blank_to_null(F.regexp_extract(text, pattern, 1)))


def address_in_text(
    text: Column, city: Column, district: Column, limit: int = 60, portal: bool = False
) -> Column:
    """From the district name on (the city too, if it stands right before) to a delimiter."""
    name = normalize_spelling(text)
    at = F.position(district, name)
    head = F.left(name, at - 1)
    tail = F.substr(name, at + F.length(district))
    gap = F.lit("") if portal else F.regexp_extract(head, r"(?U)\s*\z", 0)
    before = head if portal else F.regexp_replace(head, r"(?U)\s+\z", "")
    stop = r"(?U)\A[^\s，,。]" if portal else r"\A[^\n，,。|]"
    rest = F.regexp_extract(tail, f"{stop}{{0,{limit}}}", 0)
    prefix = F.when(F.endswith(before, city), F.concat(city, gap)).otherwise("")
    return F.when(at > 0, blank_to_null(strip(F.concat(prefix, district, rest))))


NAMES_PER_BLOCK = 100_000


def names_in_text(
    texts: DataFrame, names: DataFrame, key: str, text: str, name: str, block: int = NAMES_PER_BLOCK
) -> DataFrame:
    """Earliest (longest on a tie) of arbitrarily many names per text: ``key, name, position``.

    Names are sent to the tasks in blocks of about ``block``, each as one automaton that reads a text once
    whatever the number of names; a row keeps the best name of the blocks before. So the work is the
    texts' length times the number of blocks, nothing is shuffled, and the largest broadcast is one block.
    """
    known = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    blocks = max(1, -(-known.count() // block))
    kind = texts.schema[key].dataType.simpleString()
    schema = f"key {kind}, text string, name string, position int"
    out = texts.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("position")
    )
    context = texts.sparkSession.sparkContext
    for part in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == part)
        shared = context.broadcast([r[0] for r in own.collect()])
        out = (cut(out) if part else out).mapInArrow(_best_names(shared), schema)
    return out.filter("name IS NOT NULL").select(F.col("key").alias(key), F.col("name").alias(name), "position")


def _best_names(shared):
    def work(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for n in shared.value:
            found.add_word(n, len(n))
        found.make_automaton()
        longest = max(map(len, shared.value), default=0)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "name", "position")]
            names, places = [], []
            for text, name, position in zip(*columns, strict=True):
                best = (position - 1, -len(name)) if name is not None else None
                for end, length in found.iter(text) if text and longest else ():
                    at = (end - length + 1, -length)
                    if best is None or at < best:
                        best = at
                    if end - longest + 1 > best[0]:  # no match from here on starts as early
                        break
                names.append(text[best[0] : best[0] - best[1]] if best else None)
                places.append(best[0] + 1 if best else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text"), pa.array(names, pa.string()), pa.array(places, pa.int32())],
                ["key", "text", "name", "position"],
            )

    return work


# --- table jobs ----------------------------------------------------------------------


def reverse_lookup(gazetteer: DataFrame) -> DataFrame:
    """district, the one city it belongs to (null if several), how many there are."""
    return gazetteer.groupBy("district").agg(
        F.when(F.count_distinct("city") == 1, F.min("city")).alias("city"),
        F.count_distinct("city").alias("n_cities"),
    )


def id_names(gazetteer: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """region_id, section_id, city, district, including labels kept only for old URLs."""
    rows = gazetteer.select("region_id", "section_id", "city", "district")
    if legacy is None:
        return rows
    cities = gazetteer.select("region_id", "city").distinct()
    named = legacy.join(cities, "region_id", "left").select(
        "region_id", "section_id", "city", F.col("label").alias("district")
    )
    return rows.unionByName(named)


def district_listing(gazetteer: DataFrame) -> DataFrame:
    """One row per city with its districts in gazetteer order."""
    return gazetteer.groupBy("city").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "district"))), lambda x: x["district"]),
            "、",
        ).alias("districts"),
        F.count("*").alias("n_districts"),
        F.min("ord").alias("ord"),
    )


def validate_allowlist(allowlist: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Violations of an allow-list ``(city, districts array)``; no rows means valid."""
    wanted = allowlist.select(
        normalize_spelling(F.col("city")).alias("city"),
        F.array_distinct(F.transform("districts", normalize_spelling)).alias("districts"),
    )
    cities = gazetteer.select("city").distinct().withColumn("_known", F.lit(True))
    unknown_city = wanted.join(cities, "city", "left_anti").select(
        "city", F.lit("unknown city").alias("problem"), F.lit(None).cast("string").alias("district")
    )
    known = wanted.join(cities.select("city"), "city", "left_semi")
    star = F.array_contains("districts", "*")
    shape = known.select(
        "city",
        F.when(F.size("districts") == 0, F.lit("no district"))
        .when(star & (F.size("districts") > 1), F.lit("'*' must stand alone"))
        .alias("problem"),
        F.lit(None).cast("string").alias("district"),
    ).filter("problem IS NOT NULL")
    unknown_district = (
        known.filter(~star)
        .select("city", F.explode("districts").alias("district"))
        .join(gazetteer.select("city", "district"), ["city", "district"], "left_anti")
        .select("city", F.lit("unknown district").alias("problem"), "district")
    )
    return unknown_city.unionByName(shape).unionByName(unknown_district)
