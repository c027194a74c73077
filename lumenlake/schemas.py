"""Table schemas and vocabularies (fixed values)."""

from __future__ import annotations

CATEGORIES = ("Bracelet", "Earrings", "Necklace", "Pendant", "Ring")
SPLITS = ("train", "valid", "test")
NEGATIVE_TYPES = ("same_category", "cross_category", "random")
K_VALUES = (1, 5, 10)


# Schemas as DDL, which readers and createDataFrame take as they are.
MANIFEST = "image_id string not null, image_path string not null, group_id string not null, category string not null, category_id int not null, split string not null, source string not null"
MANIFEST_WITH_METADATA = MANIFEST + ", metadata map<string,string>"
PAIR = (
    "pair_id string, image_id_1 string, image_id_2 string, group_id_1 string, group_id_2 string, category_id_1 int, category_id_2 int, category_1 string, category_2 string, split string, label int, pair_type string, negative_type string"
)
GALLERY = "image_id string, product_id string, category string, image string, category_id int, split string, source string, embedding array<float>"
ANNOTATION = (
    "annotation_id string, query_index int, query_image_id string, query_category string, query_image_path string, rank int, product_id string, candidate_category string, similarity double, candidate_image_id string, candidate_image_path string, relevance int, notes string"
)
