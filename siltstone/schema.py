"""Row types of examples and evidence."""

MESSAGE = "struct<role:string,content:string>"
EVIDENCE = "struct<benchmark:string,method:string,confidence:double,item_index:bigint,matched_text:string,match_rank:int,reason:string>"
EXAMPLE = f"ord bigint, messages array<{MESSAGE}>, metadata variant, quality_score double, flags array<string>, evidence array<{EVIDENCE}>"
# Metadata keys that stages read and write; any others stay in the variant.
METADATA = (
    "topic", "persona", "difficulty", "style", "cluster_id", "source", "seed_cluster_id", "seed_topic", "seed_complexity", "seed_style",
    "selection_decision", "contamination_verdict", "generation_source", "pipeline_stage",
)
