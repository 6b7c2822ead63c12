"""Explicit schemas of the files that the readers take; nothing is inferred."""

COCO = """info map<string,string>, licenses array<map<string,string>>,
images array<struct<id:bigint,file_name:string,width:int,height:int,gps_lat:double,gps_lon:double,camp_id:string,dataset_id:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int,segmentation:array<array<double>>,attributes:map<string,string>>>,
categories array<struct<id:bigint,name:string,supercategory:string>>"""
GPS = "filename string, latitude double, longitude double, altitude double"
DETECTIONS = "image_id string, image_path string, width int, height int, num_tiles int, total_detections int, class_counts map<string,bigint>, has_gps boolean, gps_loc string, gsd double, timestamp string"
DUPLICATES = "duplicate string, bbox_id string, task_id string, species string"
ROI_LABELS = "roi_id bigint, class_id bigint, class_name string, original_annotation_id bigint, file_name string"
TILES = "map<string,struct<tiles_bounds:array<array<array<int>>>,tiles_gps_coords:array<array<double>>>>"
JOBS = "job_id string, job_type string, status string, progress double, parameters map<string,string>, user_id string, created_at timestamp, started_at timestamp, completed_at timestamp"
EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
