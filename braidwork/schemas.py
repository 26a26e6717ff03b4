"""Declared schemas of the tables that the operators read and write."""

KEYPOINTS = "video string, frame int, track_id int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, keypoint string, x double, y double, confidence double"
SELECTED = KEYPOINTS + ", segment_id int"
SEGMENTS = "video string, segment_id int, track_id int, start_frame int, end_frame int, frame_count int"
BOXES = "video string, frame int, bat_x1 double, bat_y1 double, bat_x2 double, bat_y2 double, bat_conf double"
JOINTS_3D = "video string, segment_id int, frame int, joints map<string, struct<x: double, y: double, z: double>>"
CHUNKS = "id string, text string, embedding_text string, parent_id string, parent_text string, source_title string, source_file string, timestamp_s int, timestamp string, section_path string, content_type string, chunk_index int, word_count int, token_count int, parent_tokens int, role string, tags array<string>"
GOLDEN = "id string, type string, q string, expect_sources array<string>, note string, _comment string"
GAMES = "game_id long, home_team string, away_team string, home_score string, away_score string, played_at long"
TEAMS = "name string"
TURNS = "session string, turn int, role string, content string"

# Keypoint names, in the order that trackers emit them.
KEYPOINT_NAMES = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
#: Keypoints that become landmarks under their own name; neck and center_hip are derived.
DIRECT_LANDMARKS = ("nose", *KEYPOINT_NAMES[5:])
