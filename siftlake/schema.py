"""Schemas of the history store: key columns first, types as they are written."""

from __future__ import annotations

#: Table to (columns, primary key). Timestamps are UTC.
TABLES: dict[str, tuple[str, list[str]]] = {
    "normalized_rows": (
        "id string, dataset string, event_type string, address_hash string, credential_hash string, row_hash string, "
        "file_id string, source_file string, fields array<string>, created_at timestamp", ["id"]),
    "canonical_addresses": (
        "canonical_hash string, address_text string, normalized_form string, embedding array<float>, created_at timestamp",
        ["canonical_hash"]),
    "address_alternates": (
        "canonical_hash string, alternate_hash string, alternate_form string, created_at timestamp",
        ["canonical_hash", "alternate_hash"]),
    "address_credentials": (
        "canonical_hash string, credential_hash string, occurrence_count long, first_seen_at timestamp, last_seen_at timestamp",
        ["canonical_hash", "credential_hash"]),
    "address_cooccurrence": (
        "canonical_hash_1 string, canonical_hash_2 string, cooccurrence_count long, first_seen_at timestamp, "
        "last_seen_at timestamp", ["canonical_hash_1", "canonical_hash_2"]),
    "address_breaches": (
        "canonical_hash string, breach_name string, title string, domain string, breach_date date, pwn_count long, "
        "description string, is_verified boolean, is_fabricated boolean, is_sensitive boolean, is_retired boolean, "
        "created_at timestamp", ["canonical_hash", "breach_name"]),
    "file_metadata": (
        "file_id string, original_filename string, sha256_hash string, blake3_hash string, file_size long, "
        "alternate_names array<string>, processing_status string, created_at timestamp", ["file_id"]),
    "chain_of_custody": (
        "file_id string, record_id string, custody_action string, operator string, file_hash string, signature string, "
        "public_key string, timestamp timestamp", ["record_id"]),
    "alias_relationships": (
        "canonical_hash string, variant_hash string, alias_type string, confidence int, created_at timestamp",
        ["canonical_hash", "variant_hash", "alias_type"]),
    "anomaly_scores": (
        "file_id string, subject_hash string, anomaly_type string, risk_score int, created_at timestamp",
        ["file_id", "subject_hash", "anomaly_type"]),
}
