"""Explicit schemas of the domain tables."""

from __future__ import annotations

IMAGES = ("dataset_id string, image_id string, file_path string, width int, height int, gps_lat double, gps_lon double, altitude_m double, captured_at timestamp, "
          "camera_make string, camera_model string, iso int, exposure_s double, focal_length_mm double, file_size_bytes long, sha1 string, qa_flags array<string>, tags array<string>")
TELEMETRY = ("flight_id string, aircraft_id string, seq long, ts timestamp, latitude double, longitude double, altitude_rel_m double, altitude_abs_m double, heading_deg double, "
             "speed_mps double, battery_pct double, battery_v double, gps_fix int, satellites int, hdop double, flight_mode string, armed boolean, waypoint_index int, waypoint_total int, link_quality_pct double")
GRID_META = "survey_id string, epsg int, is_projected boolean, unit_to_m double, a double, b double, c double, d double, e double, f double, width int, height int"
CELLS = "survey_id string, band string, row_idx int, col_idx int, value double"
DEFECTS = ("survey_id string, defect_id string, defect_type string, lon double, lat double, area_m2 double, length_m double, width_m double, severity string, confidence double, "
           "observation_count int, review_state string")
PLANNED = "mission_id string, idx long, lon double, lat double, alt_m double, yaw double, pitch double, primitive string"
AUDIT = "event_id long, created_at timestamp, user_id string, action string, resource string, detail string"
EVENTS = "event_id long, org_id long, created_at timestamp, event string, payload_json string"
