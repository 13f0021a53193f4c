"""Filters and rule flags on posts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.labels import constants

# Words that suggest the crypto topic.
CRYPTO_TERMS = [
    "topic_crypto", "cryptocurrency", "bitcoin", "btc", "ethereum", "eth", "xrp", "ripple", "solana", "avalanche", "avax", "uniswap",
    "chainlink", "lido", "metamask", "opensea", "coinbase", "binance", "kraken", "bybit", "okx", "kucoin", "coindesk",
    "cointelegraph", "blockworks", "messari", "coingecko", "coinmarketcap", "the block", "theblock", "defi", "web3", "nft",
    "blockchain", "onchain", "on-chain", "stablecoin", "stablecoins", "token", "tokens", "tokenomics", "airdrop", "airdrops",
    "wallet", "staking", "staked", "validator", "validators", "gas", "gwei", "mainnet", "testnet", "rollup", "rollups", "zk", "zkp",
    "l1", "l2", "layer 1", "layer 2", "memecoin", "meme coin", "liquidity", "tvl", "apy", "bonding curve", "bridge", "bridging",
    "satoshi", "sats", "halving", "mining", "miner", "hashrate", "custody", "self custody", "multisig", "seed phrase", "depin",
    "rwa", "rwas", "dao", "governance", "yield", "dex", "slippage", "liquidation", "liquidations", "liquidated", "tokenized", "hodl",
    "hodling", "bitcon", "polymarket", "bitwise", "microstrategy", "usdc", "usdt", "dai", "perps", "perpetuals", "perpetual",
    "futures", "spot", "cross-chain", "cross chain", "phantom", "starknet", "algorand", "aptos", "arbitrum", "injective", "sui",
    "cardano", "optimism", "cosmos", "helium", "blur", "dips", "shitcoin", "shitcoins", "100x", "10x", "moon", "mooning", "rug",
    "rugged", "rugpull", "crypto",
]
# Words beside which bags are just bags.
PLAIN_BAGS = ["gloves?", "picnic", "litter", "trash", "garbage", "surgery", "food", "transpo", "grocery", "paper", "plastic"]


def alternation(terms: list[str]) -> str:
    return "|".join(re.sub(r"([-.])", r"[\1]", t) for t in terms)


def by_beginnings(terms: list[str]) -> str:
    """The alternation of plain terms with common beginnings told once, so that a place in a text is held against a few letters, not all terms.

    It takes the same term at the same place: terms of unlike first letters exclude each other, those of a letter keep their order, and
    nothing moves past a term that ends.
    """
    parts: list[str] = []
    groups: dict[str, list[str]] = {}

    def close() -> None:
        for c, rests in groups.items():
            parts.append((f"[{c}]" if c in "-." else c) + (by_beginnings(rests) if any(rests) else ""))
        groups.clear()

    for term in terms:
        if term:
            groups.setdefault(term[0], []).append(term[1:])
        else:
            close()
            parts.append("")
    close()
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def exclude_labels(df: DataFrame, excluded: list[str], labels: str = "labels") -> DataFrame:
    """Rows without these labels, those that have none left dropped; `changed` tells which rows lost some."""
    left = F.array_except(labels, constants(excluded))
    return df.withColumn("changed", F.arrays_overlap(labels, constants(excluded))).withColumn(labels, left).where(F.size(labels) > 0)


def exclusion_count(df: DataFrame, excluded: list[str], labels: str = "labels") -> DataFrame:
    left = F.size(F.array_except(labels, constants(excluded)))
    touched = F.arrays_overlap(labels, constants(excluded)) | (left == 0)
    return df.agg(F.count_if(touched).alias("removed"), F.count_if(left > 0).alias("kept"), F.count("*").alias("n_rows"))


def pure_clean(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.where(F.col(labels) == constants(["clean"]))


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.coalesce(F.col(text), F.lit("")) != "")


def min_chars(df: DataFrame, text: str = "text", least: int = 8) -> DataFrame:
    return df.where(F.length(text) >= least)


def relabel_reasons(text: Column, addresses: Column, terms: list[str] = CRYPTO_TERMS) -> Column:
    """Why a clean post may be about crypto, in a fixed order, or ''."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("₿"), F.lit("b"))
    plain = all(re.fullmatch("[a-z0-9 .-]+", t) for t in terms)
    word = F.lower(F.regexp_extract(text, rf"(?iU)\b({by_beginnings(terms) if plain else alternation(terms)})\b", 1))
    bags = text.rlike(r"(?iU)\bbags?\b") & ~text.rlike(rf"(?iU)\b({'|'.join(PLAIN_BAGS)})\b")
    found = [
        F.when(F.size(addresses) > 0, F.lit("has_addresses")),
        F.transform(F.filter(F.array(word), lambda w: w != ""), lambda w: F.concat(F.lit("keyword:"), w)),  # looked for once
        F.when(text.rlike(r"(?U)\$[A-Za-z]{2,10}\b"), F.lit("ticker_pattern")),
        F.when(text.rlike(r"(?U)\b0x[a-fA-F0-9]{40}\b"), F.lit("eth_address")),
        F.when(bags, F.lit("crypto_bags_slang")),
    ]
    return F.concat_ws(", ", *found)


def suggest_relabel(df: DataFrame, terms: list[str] = CRYPTO_TERMS, text: str = "text", labels: str = "labels", addresses: str = "addresses") -> DataFrame:
    """Clean posts with a reason to look at them again."""
    reason = relabel_reasons(F.col(text), F.col(addresses), terms)
    # exploded, so that patterns run once a row: a filter on a column would be told anew below it
    return pure_clean(df, labels).withColumn("reason", F.explode(F.filter(F.array(reason), lambda x: x != "")))


def subgroups(short: Column, url: Column, seen: Column) -> Column:
    """The names of a post's subgroups: all, short, with_url or without_url, seen_handle or unseen_handle."""
    return F.array_compact(F.array(
        F.lit("all"), F.when(short, F.lit("short")), F.when(url, F.lit("with_url")).otherwise(F.lit("without_url")),
        F.when(F.coalesce(seen, F.lit(False)), F.lit("seen_handle")).otherwise(F.lit("unseen_handle")),
    ))


def subgroup_flags(df: DataFrame, text: str, url: Column, seen: Column) -> DataFrame:
    """Appends `subgroups`."""
    return df.withColumn("subgroups", subgroups(F.length(text) < 40, url, seen))
