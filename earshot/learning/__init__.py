"""Skip prediction and segmentation with Spark ML."""
