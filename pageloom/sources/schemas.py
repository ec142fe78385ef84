"""Explicit schemas of the state tables; nothing is inferred."""

from __future__ import annotations

POINTS = "array<struct<x:double,y:double>>"
TABLES = {
    "projects": "id string, name string, description string, source_language string, target_language string, "
                "translation_context string, settings string, created_at timestamp, updated_at timestamp",
    "image_pages": "id string, project_id string, filename string, original_path string, clean_path string, rendered_path string, "
                   "text_layer_path string, width int, height int, order_index int, status string, current_stage string, "
                   "error_message string, metadata_json string, created_at timestamp, updated_at timestamp",
    "text_regions": f"id string, image_id string, region_key string, bbox array<double>, polygon {POINTS}, translated_bbox array<double>, "
                    f"translated_polygon {POINTS}, source_text string, translated_text string, confidence double, orientation string, "
                    "reading_order int, panel_id string, bubble_id string, region_type string, font_size double, font_family string, "
                    "font_weight int, text_color string, stroke_color string, stroke_width double, alignment string, line_spacing double, "
                    "character_spacing double, rotation double, perspective_warp boolean, opacity double, locked boolean, visible boolean, "
                    "needs_review boolean, review_reasons array<string>, layout_warning boolean, layout_data string, "
                    "pixel_mask_path string, inpainted_path string, created_at timestamp, updated_at timestamp",
    "translations": "id string, region_id string, source_text string, translated_text string, source_language string, "
                    "target_language string, provider string, model string, is_current boolean, created_at timestamp",
    "model_configs": "id string, kind string, provider string, name string, config string, enabled boolean, is_default boolean, updated_at timestamp",
    "processing_batches": "id string, project_id string, context_mode string, policy string, contexts map<string,string>, created_at timestamp",
    "file_jobs": "id string, project_id string, kind string, status string, progress double, filename string, result string, "
                 "snapshot string, created_at timestamp, updated_at timestamp",
    "processing_tasks": "id string, project_id string, image_id string, task_type string, status string, execution_generation int, batch_id string, "
                        "dependency_task_id string, waiting_reason string, pause_requested boolean, active_stages array<string>, payload string, "
                        "progress double, message string, error_message string, error_kind string, created_at timestamp, updated_at timestamp",
    "task_workflows": "id string, task_id string, generation int, status string, input_fingerprint string, request_fingerprint string, "
                      "page_version string, policy string, input_state string, created_at timestamp",
    "stage_checkpoints": "id string, workflow_id string, stage string, attempt int, generation int, status string, input_fingerprint string, "
                         "result string, artifacts string, cloud_request boolean, error_kind string, created_at timestamp, finished_at timestamp",
    "task_execution_runs": "id string, task_id string, status string, started_at timestamp, finished_at timestamp, queue_seconds double, "
                           "wall_seconds double, timings map<string,struct<seconds:double,calls:bigint>>",
    "region_revisions": "id string, region_id string, action string, snapshot string, created_at timestamp",
    "editor_history": "id bigint, project_id string, image_id string, scope string, task_id string, region_ids array<string>, action string, "
                      "before string, after string, applied boolean, pending boolean, created_at timestamp",
    "mcp_operations": "id string, client_id string, tool string, fingerprint string, status string, workflow_run_id string, result string, created_at timestamp",
    "mcp_assets": "id string, kind string, status string, size bigint, evidence string, created_at timestamp",
    "agent_review_issues": "id string, project_id string, image_id string, workflow_run_id string, region_id string, page_version string, category string, "
                           "message string, status string, created_at timestamp",
    "mcp_workflow_runs": "id string, project_id string, workflow_id string, workflow_version string, page_ids array<string>, options string, created_at timestamp",
    "mcp_workflow_pages": "id string, run_id string, image_id string, preflight string, final_review string, assignment string, "
                          "correction_open boolean, correction_rounds int",
}
REGION_JSON = ("struct<region_id:string,bbox:array<double>,translated_bbox:array<double>,source_text:string,translated_text:string,"
               "confidence:double,orientation:string,reading_order:bigint,font:struct<family:string,size:double>>")
PAGE_JSON = ("schema_version int, project struct<name:string,description:string,source_language:string,target_language:string>, "
             f"page struct<id:bigint,order_index:bigint,width:bigint,height:bigint>, regions array<{REGION_JSON}>")
