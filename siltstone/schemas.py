"""Schemas of the records that pass between stages, as Spark DDL."""

BLOCK = "struct<pos:int,tag:string,text:string,plain:string>"
PARSED = f"blocks array<{BLOCK}>, clean string, links array<string>, error string"
CHUNK = "chunk_id string, doc_id string, source string, source_path string, section string, text string, ordinal int"
QA_PAIR = "doc_id string, section string, question string, answer string, context string"
SPLIT_ROW = f"{QA_PAIR}, inferred_topic string, split string"
EVAL_RESULT = "label string, score double, model string, timestamp string"
PROGRAM_STATE = "predictor string, instruction string, demos array<struct<question:string,answer:string>>"
