"""Column layouts of the stored layers."""

BRONZE = """pipeline_run_id string, source_file_hash string, raw_response string, model_name string,
 model_provider string, prompt_version string, ingested_at timestamp, ingest_date date"""

SILVER = """line_id string, source_file_hash string, drug_name_raw string, drug_name_normalized string,
 dosage_value double, dosage_unit string, frequency string, quantity int,
 extraction_confidence double, pipeline_run_id string, processed_at timestamp,
 rejection_reason string"""

GOLD = """line_id string, source_file_hash string, drug_name_normalized string,
 matched_product string, matched_salt string, match_score int, match_method string,
 brand_price double, generic_name string, generic_price double, saving double,
 pipeline_run_id string, matched_at timestamp"""

METRICS = """pipeline_run_id string, run_started_at timestamp, run_finished_at timestamp,
 bronze_rows int, silver_rows int, quarantine_rows int, gold_rows int, matched_rows int,
 match_rate double, mean_confidence double, stage_durations_sec map<string,double>,
 status string, validation_failures map<string,int>"""

MEDICINES = """array<struct<raw_text:string, normalized_name:string, dosage:string,
 frequency:string, confidence:string>>"""

DOSE_RULES = """id string, label string, salts array<string>, type string, mg_per_kg_low double,
 mg_per_kg_high double, frequency string, max_doses_per_day int, max_single_mg double,
 min_age_months int, syrups array<struct<label:string, mg_per_ml double>>,
 fixed_doses array<struct<age_label:string, dose_mg:double, dose_text:string>>, notes string"""
