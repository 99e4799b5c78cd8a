"""Schemas of the contact-memory tables. An added column is nullable; readers merge schemas."""

from __future__ import annotations

_STAMPS = "created_at timestamp, updated_at timestamp, deleted_at timestamp"

SCHEMAS = {
    "people": f"id long, display_name string, photo_path string, relationship string, trust_score double, merged_into_id long, {_STAMPS}",
    "organizations": f"id long, name string, category string, website string, website_domain string, {_STAMPS}",
    "org_branches": f"id long, org_id long, address string, lat double, lng double, phone string, is_primary boolean, {_STAMPS}",
    "roles": f"id long, person_id long, org_id long, title string, is_current boolean, start_date timestamp, end_date timestamp, {_STAMPS}",
    "cards": "id long, type string, image_path string, back_image_path string, thumb_path string, raw_ocr_text string, "
    f"ocr_engine string, ocr_confidence double, extraction_status string, captured_at timestamp, person_id long, org_id long, role_id long, {_STAMPS}",
    "card_fields": "id long, card_id long, field_key string, value string, normalized_value string, source string, confidence double, "
    f"verified_by_user boolean, validation_issue string, value_kind string, region_rect string, {_STAMPS}",
    "contact_points": "id long, owner_type string, owner_id long, kind string, value string, normalized_value string, label string, "
    f"role_id long, source_card_id long, source string, is_active boolean, {_STAMPS}",
    "ocr_blocks": "id long, card_id long, text string, rect string, confidence double, script string, engine string, "
    "assigned_field_key string, field_id long, order_index int",
    "extraction_attempts": "id long, card_id long, engine string, started_at timestamp, duration_ms long, status string, "
    "fields_found int, error_code string, error_detail string",
    "notes": f"id long, subject_type string, subject_id long, body string, audio_path string, transcript string, language string, {_STAMPS}",
    "attributes": f"id long, subject_type string, subject_id long, key string, value string, source string, confidence double, {_STAMPS}",
    "capability_profiles": f"id long, subject_type string, subject_id long, canonical_en string, services array<string>, categories array<string>, model string, {_STAMPS}",
    "embeddings": f"id long, subject_type string, subject_id long, vector array<float>, dim int, model string, {_STAMPS}",
    "interactions": "id long, subject_type string, subject_id long, kind string, detail string, occurred_at timestamp",
    "tags": f"id long, name string, {_STAMPS}",
    "subject_tags": "tag_id long, subject_type string, subject_id long",
    "search_queries": "id long, raw string, normalized string, lang string, created_at timestamp",
    "search_feedback": "id long, query_id long, subject_type string, subject_id long, verdict string, created_at timestamp",
    "ranking_weights": "key string, value double",
    "duplicate_candidates": f"id long, subject_type string, a_id long, b_id long, score double, signals array<string>, status string, {_STAMPS}",
}

# What the closed text columns may hold.
ALLOWED = {
    ("card_fields", "source"): ["printed", "user", "aiInferred", "outdated", "verified"],
    ("card_fields", "value_kind"): ["text", "imageCrop"],
    ("cards", "extraction_status"): ["pending", "partial", "complete", "failed", "manual"],
    ("cards", "type"): [
        "visitingCard", "warrantyCard", "receipt", "invoice", "coupon", "loyaltyCard", "membershipCard",
        "eventPass", "serviceCentreCard", "unknown",
    ],
    ("contact_points", "kind"): ["phone", "whatsapp", "email", "website", "social", "fax"],
    ("interactions", "kind"): [
        "scanned", "viewed", "called", "messaged", "emailed", "quoted", "used", "reminded", "edited",
    ],
    ("extraction_attempts", "status"): ["success", "partial", "failed"],
    ("search_feedback", "verdict"): ["useful", "not_relevant", "outdated", "wrong_person", "wrong_category"],
    ("duplicate_candidates", "status"): ["pending", "linked", "rejected"],
}
# Shortest and longest name a row may carry.
LENGTHS = {("people", "display_name"): (1, 200), ("organizations", "name"): (1, 300)}
