"""One wide row of normalised columns for each record, by normaliser family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import fixed, text

#: Input columns of a record.
NAME, ADDRESS, COUNTRY, ID = "business_name", "business_address", "country", "entity_id"


def normalised(df: DataFrame, family: str) -> DataFrame:
    """id, country, row_idx (if given) and the derived columns that channels and scores use."""
    name, address, country = F.col(NAME), F.col(ADDRESS), F.coalesce(F.col(COUNTRY), F.lit(""))
    raw_digits = family in ("contracting", "noise")
    fold = F.lit(None)
    if family == "contracting":
        clean_name, clean_addr = text.contract_name(name), text.contract_address(address)
    elif family == "noise":
        clean_name, clean_addr = text.strip_noise(name), text.plain_folded(address)
    elif family == "plain":
        clean_name, clean_addr = text.plain(name), text.plain(address)
    elif family in ("spaced", "late"):
        clean_name, clean_addr = text.spaced(name), text.spaced(address)
    elif family in ("suffixed", "suffixed_once"):
        clean_name = text.strip_suffix(text.plain_folded(name), fixed.LEGAL_SUFFIXES if family == "suffixed" else fixed.LEGAL_SUFFIXES[:-1], family == "suffixed")
        fold = text.plain_folded(name)
        clean_addr = F.array_join(text.mapped(text.words(text.plain_folded(address)), fixed.EXPAND_PRODUCTION), " ")
    elif family == "joined":
        clean_name, clean_addr = text.joined(name), text.joined(address)
    else:
        raise ValueError(f"unknown normaliser {family!r}")
    keep = [c for c in ("row_idx",) if c in df.columns]
    base = df.select(
        F.col(ID).alias("id"), country.alias("country"), *keep,
        clean_name.alias("clean_name"), clean_addr.alias("clean_addr"), text.text(name).alias("raw_name"), text.text(address).alias("raw_addr"), fold.cast("string").alias("folded"),
    )
    cn, ca = F.col("clean_name"), F.col("clean_addr")
    late = family in ("late", "suffixed", "suffixed_once")
    table = fixed.EXPAND_LATE if family == "late" else fixed.EXPAND_WIDE
    if family == "late":
        state, street, alpha = text.state_near_end(ca, F.col("country")), text.street_not_postal(ca), text.alpha("raw_name")
    elif family.startswith("suffixed"):
        state, street, alpha = text.state_longest(F.lower(F.col("raw_addr")), F.col("country")), text.leading_number(ca), F.regexp_replace(cn, "[^a-z0-9]", "")
    elif family == "joined":
        state, street, alpha = F.lit(""), text.street_number(ca), text.alpha(cn)
    else:
        state, street, alpha = text.state_first(ca, F.col("country")), text.leading_number(ca), text.alpha_stripped("raw_name")
    return base.select(
        "id", "country", *keep, "clean_name", "clean_addr",
        alpha.alias("alpha"),
        text.domain_stem("raw_name", fixed.DOMAINS_LATE if late else fixed.DOMAINS).alias("domain"),
        text.has_indic("raw_name").alias("indic"),
        state.alias("state"), street.alias("street"),
        text.postal(F.col("raw_addr") if raw_digits else ca).alias("postal"),
        text.digits(F.col("raw_addr") if raw_digits else ca).alias("digits"),
        (text.name_tokens(cn) if family == "contracting" else text.content_tokens(cn, least=3) if family == "noise" else text.content_tokens(cn) if family == "joined" else F.array_except(text.word_set(cn), text.literals(fixed.SHORT_STOPWORDS)) if family.startswith("suffixed") else text.word_set(cn)).alias("name_tokens"),
        text.content_tokens(cn, least=3).alias("content_tokens"),
        text.word_set(F.coalesce(F.col("folded"), cn)).alias("raw_tokens"),
        (F.array_except(text.word_set(ca), text.literals(fixed.SHORT_STOPWORDS)) if family.startswith("suffixed") else text.word_set(ca)).alias("addr_tokens"),
        text.expanded(ca, table, keep_short=family == "joined").alias("expanded"),
        text.specific_tokens(text.word_set(ca)).alias("specific"),
        text.ngram_set(cn, 3).alias("ng3"), text.ngram_set(cn, 4).alias("ng4"),
        text.legal_suffix(cn).alias("suffix"),
    )
