"""Files that runs leave: bundles, the run index, the feature cache, reports and charts."""
