"""Schemas of the navigation documents."""

XYZ = "struct<x:double,y:double,z:double>"
LABELS = f"array<struct<label:string,ins_id:string,bounding_box:array<{XYZ}>>>"
INSTANCE = (
    "category_id int, category_label string, instance_id string, item_id string, bbox_m array<string>, bbox_xywh_m array<string>, area int, "
    "height_m string, min_z_m string, max_z_m string, mask_coords_m array<array<string>>"
)
POINT = (
    "struct<point:string,position:array<double>,rotation:array<double>,action:array<string>,camera_images:array<string>,focal_length:double,"
    "horizontal_aperture:double,vertical_aperture:double,focus_distance:double,clipping_range:array<double>>"
)
# an instruction is an object or a bare text, so it stays JSON until text.normalised_instruction()
SAMPLE = f"struct<trajectory_id:string,instructions:array<string>,points:array<{POINT}>>"
TRAJECTORIES = f"dataset_metadata struct<name:string>, scenes array<struct<scene_id:string,scene_name:string,samples:array<{SAMPLE}>>>"
SCENE_TYPES = "world_id int, design_type string"
ENDPOINTS = "start string, end string"
ACTIONS = (
    "scene_id string, trajectory_id string, instruction_index int, instruction string, action_sequence array<string>, "
    "sampled_points array<struct<point_id:string,position:array<double>,rotation:array<double>>>, "
    "trajectory_stats struct<total_points:int,final_sampled_points:int,total_distance:double,total_actions:int,action_breakdown:map<string,int>>"
)
IMAGES = "scene_id string, trajectory_id string, instruction_index int, frame_filenames array<string>, sampling_info struct<sampled_points_count:int,generated_images_count:int,data_source:string>"
TRAINING = "video_id string, q string, a string, frames array<string>"
MAPPING = (
    "split_type string, scenes map<string,struct<scene_id:string,total_instruction_pairs:int,scene_type:string,design_type:string,test_type:string,"
    "trajectories:array<struct<trajectory_id:string,instruction_count:int,length_category:string,instruction_types:map<string,int>,"
    "selected_instruction_indices:array<int>,available_instruction_indices:array<int>,test_type:string>>>>"
)
STEPS = "episode_id string, seq int, t double, x double, y double, z double, yaw double, collided boolean"
