"""Declared schemas of the logical tables; readers never infer."""

OUTLETS = (
    "outlet_code string, outlet_name string, address string, district string, circle string, depot_code string, "
    "depot_name string, lat double, lng double, status string, vendor_type string"
)
SALES_DAILY = (
    "outlet_code string, date date, cases int, bottles int, total_bottles int, sale_value double, district string, "
    "depot_code string, circle string, vendor_type string"
)
PRODUCTS = (
    "product_code string, brand_code string, brand_name string, size_ml int, units_per_case int, basic_price double, "
    "supplier_code string, category string, brand_type string, mrp double, issue_price double, distillery string, "
    "supplier_address string, supplier_type string, office_address string"
)
LABEL_APPROVALS = (
    "application_no string, type string, label_type string, label_category string, approval_date date, "
    "distillery string, unit_name string, brand_name string, size_ml double, pack_type string, basic_price double, "
    "mrp double, category string"
)
TENDERS = (
    "tender_id string, source_id string, source_tender_url string, title string, reference_number string, "
    "organisation string, department string, state string, location string, tender_category string, "
    "product_category string, form_of_contract string, tender_type string, tender_value_inr decimal(20,2), "
    "emd_inr decimal(20,2), published_date date, closing_date date, bid_opening_date date, has_corrigendum boolean, "
    "has_award boolean, discovered_at timestamp, updated_at timestamp, status string"
)
DOCUMENTS = (
    "document_id string, tender_id string, source_id string, source_url string, final_url string, anchor_text string, "
    "file_name string, file_path string, content_type string, file_extension string, file_size_bytes long, "
    "sha256 string, downloaded_at timestamp, status string, skip_reason string, error_message string, "
    "classified_type string, classification_confidence double, near_duplicate_of string"
)
EXTRACTED_TEXTS = (
    "document_id string, extracted_text_path string, text_preview string, page_count int, language_guess string, "
    "extraction_status string, extraction_error string, manual_review_required boolean"
)
RELEVANCE = (
    "document_id string, relevance_score int, relevance_reasons array<string>, recommended_for_training boolean, "
    "recommended_for_demo boolean, scored_at timestamp"
)
COMPLIANCE_LOG = (
    "timestamp timestamp, run_id string, source_id string, url string, decision string, rule_triggered string, "
    "reason string"
)
TRAINING_MANIFEST = (
    "document_id string, tender_id string, source_id string, document_type string, file_path string, "
    "extracted_text_path string, relevance_score int, language string, page_count int, run_id string"
)
SIGNALS = (
    "source string, signal_date string, signal_type string, geo_relevance string, affected array<string>, "
    "impact_direction string, confidence double, alters string, headline string"
)
RULES = (
    "rule_id string, description string, required_inputs map<string,string>, python_logic string, "
    "rule_specific_documents array<string>, verbatim_chunk string, associated_assets array<string>"
)
EXTRACTION = (
    "Rules array<struct<rule_id:string,description:string,python_logic:string,verbatim_chunk:string,"
    "associated_assets:array<string>>>, Processes array<struct<process_name:string,associated_rules:array<string>>>, "
    "Visual_Assets array<struct<asset_id:string,asset_type:string,page_number:int>>"
)
SOURCE_REGISTRY = (
    "source_id string, source_name string, base_url string, country string, source_type string, "
    "allowed_paths array<string>, parser_name string, allowed_file_extensions array<string>, robots_required boolean, "
    "review struct<approved:boolean,tos_url:string,tos_summary:string,reviewed_by:string,reviewed_on:string>, "
    "limits struct<rate_limit_seconds:double,max_pages_per_run:int,max_documents_per_run:int>, "
    "discovery struct<mode:string,sitemap_url:string,search_pages:array<string>>"
)
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
GEOJSON = f"type string, features array<{FEATURE}>"
