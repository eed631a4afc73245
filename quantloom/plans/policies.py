"""What of a record of each type is for reading, and in which order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    drop: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    expand: tuple[str, ...] = ()


#: Fields that are left out, the order of the others, fields whose members become columns, by record type.
POLICIES = {
    "Instrument": Policy(
        drop=("instrument_id", "provider_identifiers", "instrument_key", "exchange_token", "tick_size", "lot_size", "freeze_quantity", "cas_eligible"),
        order=("isin", "symbol", "exchange", "name", "short_name", "segment", "series", "security_type", "sector", "industry", "currency", "active"),
    ),
    "PriceBar": Policy(drop=("instrument_id",), order=("timestamp", "open", "high", "low", "close", "volume", "turnover", "delivery_quantity", "delivery_percent")),
    "MarketQuote": Policy(
        drop=(
            "instrument_id", "bid_depth", "ask_depth", "raw_quote", "total_buy_quantity", "total_sell_quantity", "open_interest", "previous_oi", "oi_day_high", "oi_day_low",
            "indicative_imbalance_quantity_total", "indicative_imbalance_quantity_market",
        ),
        order=(
            "timestamp", "last_price", "previous_close", "net_change", "day_open", "day_high", "day_low", "volume", "year_high", "year_low", "average_price", "last_trade_time", "ohlc_timestamp",
            "reference_price",
        ),
    ),
    "FundamentalSnapshot": Policy(
        drop=("instrument_id",), order=("period_end", "period_start", "period_type", "statement_type", "statement_name", "fiscal_year", "units_in"), expand=("metrics",)
    ),
    "ShareholdingSnapshot": Policy(drop=("instrument_id",), order=("period_end", "holders")),
    "CorporateAction": Policy(
        drop=("instrument_id",),
        order=(
            "action_type", "announcement_date", "ex_date", "record_date", "amount", "ratio", "details", "face_value", "company_name", "series", "book_closure_start", "book_closure_end",
        ),
    ),
    "CompanyEvent": Policy(drop=("event_id", "instrument_id"), order=("event_type", "event_date", "announcement_date", "subject", "description", "url", "details")),
    "NewsItem": Policy(drop=("news_id", "instrument_ids"), order=("published_at", "source_name", "title", "text", "url")),
    "CompanyDocument": Policy(
        drop=("document_id", "instrument_id", "filing_id", "raw_ref", "text_ref", "content_hash"), order=("document_type", "published_at", "title", "url", "mime_type", "byte_size")
    ),
    "Filing": Policy(
        drop=("filing_id", "instrument_id"),
        order=(
            "filing_type", "category", "subcategory", "period_end", "period_start", "financial_year", "statement_type", "submission_type", "audited", "published_at", "received_at", "revised_at",
            "revision_remarks", "details_url", "assets",
        ),
    ),
    "DocumentAsset": Policy(
        drop=("asset_id", "filing_id", "instrument_id", "content_hash", "sha256", "local_path", "text_ref"), order=("document_type", "title", "url", "mime_type", "byte_size")
    ),
    "XBRLFact": Policy(
        drop=("filing_id", "instrument_id", "context_ref", "unit_ref", "raw_xml"),
        order=("concept", "label", "value", "decimals", "period_start", "period_end", "instant", "dimensions"), expand=("dimensions",),
    ),
    "CompanyPeer": Policy(drop=("instrument_id", "peer_instrument_key", "peer_isin"), order=("peer_name", "sector", "description", "sector_market_cap_inr", "sector_market_cap_usd")),
    "InsiderTransaction": Policy(
        drop=("event_id", "instrument_id", "xbrl_url"),
        order=(
            "intimation_date", "company_name", "person_name", "person_category", "transaction_type", "security_type_prior", "securities_prior", "holding_percent_prior", "security_type_acquired",
            "securities_acquired", "transaction_value", "security_type_post", "securities_post", "holding_percent_post", "acquisition_from", "acquisition_to", "mode", "buy_value", "buy_quantity",
            "sell_value", "sell_quantity", "remarks",
        ),
    ),
    "LargeDeal": Policy(drop=("event_id", "instrument_id"), order=("trade_date", "company_name", "deal_type", "client_name", "side", "quantity", "weighted_average_price", "remarks", "details")),
    "SectorClassification": Policy(drop=("instrument_id", "symbol"), order=("classification_as_of", "sector_macro", "sector", "industry", "basic_industry")),
    "IndexPriceBar": Policy(drop=("index_id", "index_symbol", "index_name"), order=("timestamp", "open", "high", "low", "close")),
    "IndexSnapshot": Policy(
        drop=("index_id", "index_symbol", "index_name"),
        order=(
            "timestamp", "value", "change", "change_percent", "previous_close", "open", "high", "low", "year_high", "year_low", "one_year_return_percent", "one_month_return_percent",
            "constituent_count",
        ),
    ),
    "IndexValuationSnapshot": Policy(drop=("index_id", "index_symbol", "index_name"), order=("observation_date", "pe", "pb", "dividend_yield")),
    "IndexConstituent": Policy(
        drop=("index_id", "index_symbol", "index_name", "instrument_id"),
        order=(
            "effective_date", "symbol", "company_name", "weight_percent", "rank", "price", "change", "change_percent", "market_cap", "free_float_market_cap", "volume", "traded_value",
        ),
    ),
    "MacroObservation": Policy(drop=("series_id",), order=("observation_date", "value", "unit")),
    "MacroSeries": Policy(drop=("series_id",), order=("name", "description", "frequency", "unit", "source")),
    "MacroRelease": Policy(drop=("release_id",), order=("published_at", "title", "reference_period", "source", "url")),
    "RegulatoryItem": Policy(
        drop=("regulatory_id", "instrument_ids"), order=("category", "subcategory", "published_at", "title", "department", "section", "detail_url", "document_urls", "entity_names")
    ),
    "RegulatoryDocument": Policy(drop=("document_id", "regulatory_id", "content_hash", "local_path"), order=("title", "url", "mime_type", "byte_size", "text_ref")),
}
